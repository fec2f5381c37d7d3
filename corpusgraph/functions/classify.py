"""Ordered naming rules for source files: three rule sets (a tree to embed, packages of a workspace, a code graph)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules for a tree to embed.
CODE_EXTENSIONS = (".tsx", ".ts")
STYLE_EXTENSIONS = (".scss", ".css")
DOC_EXTENSIONS = (".md",)
CONFIG_EXTENSIONS = (".json",)
TREE_LANGUAGES = {".tsx": "tsx", ".ts": "typescript", ".scss": "scss", ".css": "scss", ".md": "markdown", ".json": "json"}
TREE_SKIPPED_FOLDERS = ("node_modules", "dist", "build", ".git", "__pycache__", "coverage", ".turbo", ".next", ".storybook", "__tests__")
TREE_SKIPPED_PARTS = (".test.", ".spec.", ".stories.")

# Fixed values of the rules for packages of a workspace.
PACKAGE_LANGUAGES = {".tsx": "typescript", ".ts": "typescript", ".jsx": "javascript", ".js": "javascript", ".scss": "scss", ".css": "css", ".md": "markdown", ".json": "json"}
PACKAGE_SKIPPED_NAMES = ("pnpm-lock.yaml", "pnpm-workspace.yaml", ".npmrc", ".prettierrc", ".prettierignore", ".gitignore", "vite-env.d.ts", "vitest.shims.d.ts")
PACKAGE_SKIPPED_PARTS = ("-bkp.", "tsconfig.app.", "tsconfig.node.")
PACKAGE_SKIPPED_EXTENSIONS = (".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".eot", ".ttf", ".pdf", ".lock")
TARGETS = {"readme": ("docs",), "story": ("docs",), "type_definition": ("code", "config"), "json_config": ("config",), "registry": ("code", "config"), "mapper": ("code", "config")}
CONTENT_OF_CATEGORY = {"readme": "doc", "story": "doc", "package_manifest": "doc", "type_definition": "config", "json_config": "config", "registry": "config"}

# Fixed values of the rules for a code graph.
GRAPH_SKIPPED_ENDS = (".stories.tsx", ".stories.ts", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", "vitest.config.ts", "tsup.config.ts", "vitest.shims.d.ts", ".d.ts")
GRAPH_SKIPPED_FOLDERS = ("node_modules", "dist", ".storybook", "__pycache__")

HOOK = r"^use\p{Lu}"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last extension with its dot, in lower case; a leading dot begins a name, not an extension."""
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^./]+$", "")


def has(text: Column, *parts: str) -> Column:
    """Whether any of the parts occurs."""
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def ends(text: Column, *parts: str) -> Column:
    out = text.endswith(parts[0])
    for p in parts[1:]:
        out = out | text.endswith(p)
    return out


def chosen(rules: Sequence[tuple[Column, str]], other: str) -> Column:
    """The value of the first rule that holds."""
    out = F.when(*_pair(rules[0]))
    for rule in rules[1:]:
        out = out.when(*_pair(rule))
    return out.otherwise(F.lit(other))


def _pair(rule: tuple[Column, str]) -> tuple[Column, Column]:
    return rule[0], F.lit(rule[1])


def looked_up(table: Mapping[str, str], key: Column, other: str | None = None) -> Column:
    if not table:
        return F.lit(other).cast("string")
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return found if other is None else F.coalesce(found, F.lit(other))


def in_folder(path: Column, folders: Sequence[str]) -> Column:
    """Whether a folder of the path has one of the names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in folders]))


# A tree to embed.


def language(name: Column) -> Column:
    return looked_up(TREE_LANGUAGES, suffix(name), "unknown")


def content_type(name: Column) -> Column:
    e = suffix(name)
    return chosen([(e.isin(*CODE_EXTENSIONS), "code"), (e.isin(*STYLE_EXTENSIONS), "style"), (e.isin(*DOC_EXTENSIONS), "doc")], "config")


def category(path: Column, name: Column) -> Column:
    e, low = suffix(name), F.lower(path)
    return chosen(
        [
            (e.isin(*STYLE_EXTENSIONS), "style"),
            (e.isin(*DOC_EXTENSIONS), "doc"),
            (e.isin(*CONFIG_EXTENSIONS), "config"),
            (has(name, ".types", ".type."), "type"),
            (has(F.lower(name), "config"), "config"),
            (stem(name).rlike(HOOK), "hook"),
            (stem(name).rlike(r"^\p{Lu}"), "component"),
            (has(low, "service", "/api/"), "service"),
            (has(low, "util", "helper"), "util"),
        ],
        "unknown",
    )


def skipped(path: Column, size: Column) -> Column:
    """Files of other extensions, declarations, tests and stories, empty files, and whatever lies in a skipped folder."""
    name = base_name(path)
    known = suffix(name).isin(*CODE_EXTENSIONS, *STYLE_EXTENSIONS, *DOC_EXTENSIONS, *CONFIG_EXTENSIONS)
    return ~known | name.endswith(".d.ts") | has(name, *TREE_SKIPPED_PARTS) | (size == 0) | in_folder(path, TREE_SKIPPED_FOLDERS)


# Packages of a workspace.


def package_language(name: Column) -> Column:
    return looked_up(PACKAGE_LANGUAGES, suffix(name), "text")


def package_skipped(name: Column, size: Column) -> Column:
    return name.isin(*PACKAGE_SKIPPED_NAMES) | suffix(name).isin(*PACKAGE_SKIPPED_EXTENSIONS) | has(name, *PACKAGE_SKIPPED_PARTS) | (size == 0)


def module_path(path: Column, prefix: Column) -> Column:
    """The folder of a file under the prefix, empty for a file right there."""
    inside = F.regexp_replace(F.substr(path, F.length(prefix) + 1), "^/+", "")
    return F.regexp_replace(inside, "/?[^/]*$", "")


def package_category(path: Column, name: Column) -> Column:
    low = F.lower(name)
    return chosen(
        [
            (name.isin("index.ts", "index.tsx"), "barrel_export"),
            (has(name, ".types.ts", ".type.ts"), "type_definition"),
            (has(name, ".stories.tsx", ".stories.ts"), "story"),
            (ends(name, ".scss", ".css"), "style"),
            (stem(name).rlike(HOOK), "hook"),
            (has(path, "store/") | has(name, "Store", "Slice", "slice"), "store_slice"),
            (has(path, "api/") | has(name, "apiClient", "axiosInstance"), "api_client"),
            ((name == "Dockerfile") | has(low, "config.ts", "config.js"), "build_config"),
            (has(name, "Registry"), "registry"),
            (has(name, "Mapper", "mapper"), "mapper"),
            (has(name, "Pagination", "FileIcons"), "sub_component"),
            (name == "tokenManager.ts", "api_client"),
            (name.endswith(".json"), "json_config"),
            (name.endswith(".md"), "readme"),
        ],
        "component",
    )


def layer(package: Column, layers: Mapping[str, str], other: str = "infra") -> Column:
    """The architecture layer of a package by a given table."""
    return looked_up(layers, package, other)


def targets(package_category: Column) -> Column:
    """The collections that a file goes into, one or more."""
    out = None
    for name, where in TARGETS.items():
        value = F.array(*[F.lit(x) for x in where])
        out = F.when(package_category == name, value) if out is None else out.when(package_category == name, value)
    return out.otherwise(F.array(F.lit("code")))


def category_content(package_category: Column) -> Column:
    """The content type of a package file's category."""
    return looked_up(CONTENT_OF_CATEGORY, package_category, "code")


def component_type(name: Column) -> Column:
    """What an exported name seems to be."""
    return chosen([(name.rlike(HOOK), "hook"), (has(name, "Dashboard", "UserList"), "dashboard"), (has(name, "Form"), "form"), (has(name, "Shell", "Route", "App"), "shell"), (has(name, "Wizard"), "wizard")], "component")


# A code graph.


def graph_skipped(path: Column) -> Column:
    name = base_name(path)
    return ~suffix(name).isin(".ts", ".tsx") | ends(name, *GRAPH_SKIPPED_ENDS) | in_folder(path, GRAPH_SKIPPED_FOLDERS)


def graph_file_type(name: Column, content: Column) -> Column:
    low = F.lower(name)
    return chosen(
        [
            (low.isin("index.ts", "index.tsx"), "index"),
            (ends(low, ".types.ts", ".types.tsx"), "types"),
            (has(low, "hook") | content.rlike(r"\buse[A-Z]"), "hook"),
            (low.endswith(".tsx") & content.rlike(r"\bReact\b|\bJSX\b|return\s*\("), "component"),
            (has(low, "config", "settings"), "config"),
            (has(low, "util", "helper"), "utility"),
        ],
        "module",
    )
