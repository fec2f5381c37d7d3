"""What source files import and export, by patterns, and where relative imports point to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of statements.
ANY_IMPORT = r"""(?:import|from)\s+(?:[^'"]*?\s+from\s+)?['"]([^'"]+)['"]"""
PLAIN_IMPORT = r"""(?:import|from)\s+['"]([^'"]+)['"]"""
EXPORTED = r"(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:const|let|var|function\*?|class|type|interface|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
EXPORT_LIST = r"(?m)^export\s+\{([^}]+)\}"
GRAPH_IMPORT = r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:\{([^}]*)\}|(\w+)|(\*\s+as\s+\w+)|(\{[^}]*\}\s*,\s*\w+))?\s*(?:,\s*(?:\{[^}]*\}|\w+|\*\s+as\s+\w+))?\s*from\s+['"]([^'"]+)['"]"""
STAR_FROM = r"""(?m)^[ \t]*export\s+\*\s+from\s+['"]([^'"]+)['"]"""
NAMED_FROM = r"""(?m)^[ \t]*export\s+\{([^}]*)\}\s+from\s+['"]([^'"]+)['"]"""
DECLARED = r"(?m)^[ \t]*export\s+(?:default\s+)?(abstract\s+class|class|function\s*\*?|const|let|var|interface|type|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
DEFAULT = r"(?m)^[ \t]*export\s+default\s+(function|class)\s*([A-Za-z_$][A-Za-z0-9_$]*)?"
BRACES = r"(?m)^[ \t]*export\s+\{([^}]*)\}\s*;"
SYMBOL_TYPES = {"class": "class", "abstract": "class", "function": "function", "const": "constant", "let": "constant", "var": "constant", "interface": "interface", "type": "type", "enum": "enum"}
#: What a relative import may leave out, in the order that is tried.
ENDINGS = (".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx")


def found(source: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(group))


def listed(names: Column) -> Column:
    """The trimmed, non-empty members of a list in braces."""
    return F.filter(F.transform(F.split(names, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def original(name: Column) -> Column:
    """What stands before "as"."""
    return F.trim(F.element_at(F.split(name, " as "), 1))


def outside(name: Column) -> Column:
    """What stands after "as"."""
    return F.trim(F.element_at(F.split(name, " as "), -1))


def distinct_sorted(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def imports(source: Column) -> Column:
    """Distinct import specifiers in the order of their first use, side-effect imports too."""
    return F.array_distinct(F.filter(F.transform(found(source, ANY_IMPORT), lambda x: F.trim(x)), lambda x: x != ""))


def scoped_imports(source: Column, scope: str, strip_letters: bool = False, loose: bool = False) -> Column:
    """struct<symbols, packages>: what is imported by name from packages of a scope ("@x/"), and all those packages.

    An alias counts as its original, and a leading "type " goes; strip_letters strips any leading t, y, p or e instead.
    loose: members as they are but for "type ", and packages of any import on a line."""
    import re

    s = re.escape(scope)
    named = rf"""import\s+(?:type\s+)?\{{([^}}]+)\}}\s+from\s+['"]({s}[^'"]+)['"]"""
    default = rf"""import\s+(?:type\s+)?(?:\*\s+as\s+\w+|\w+)\s+from\s+['"]({s}[^'"]+)['"]"""
    if loose:
        default = rf"""(?:import|from)\s+.*?['"]({s}[^'"]+)['"]"""
    members = F.flatten(F.transform(found(source, named, 1), listed))
    if loose:
        symbols = F.transform(members, lambda x: F.replace(x, F.lit("type "), F.lit("")))
    else:
        symbols = F.transform(members, lambda x: original(F.regexp_replace(x, "^[type]+" if strip_letters else r"^type\s+", "")))
    packages = F.transform(F.concat(found(source, named, 2), found(source, default, 1)), lambda x: F.trim(x))
    return F.struct(distinct_sorted(symbols).alias("symbols"), distinct_sorted(packages).alias("packages"))


def exports(source: Column) -> Column:
    """Distinct names that declarations at the start of a line export, then those of export braces (as they are called outside)."""
    named = F.transform(F.flatten(F.transform(found(source, EXPORT_LIST), listed)), outside)
    return F.array_distinct(F.filter(F.concat(found(source, EXPORTED), named), lambda x: x != ""))


def exports_within(segment: Column, names: Column) -> Column:
    """Those of the file's exports that occur as a whole word in a segment of it."""
    quoted = lambda x: F.concat(F.lit(r"\b\Q"), x, F.lit(r"\E\b"))
    return F.filter(names, lambda x: F.regexp_like(segment, quoted(x)))


def symbol_type(keyword: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in SYMBOL_TYPES.items() for x in p])[keyword], F.lit("unknown"))


def typed_exports(source: Column) -> Column:
    """array<struct<name, symbol_type>>: each exported name once; the last declaration gives the type, names in braces only add."""
    entry = lambda e: F.struct(e["n"].alias("name"), symbol_type(F.element_at(F.split(F.trim(e["k"]), r"\s+"), 1)).alias("symbol_type"))
    declared = F.transform(F.arrays_zip(found(source, DECLARED, 1).alias("k"), found(source, DECLARED, 2).alias("n")), entry)
    names = F.transform(found(source, DEFAULT, 2), lambda x: F.when(x == "", F.lit("default")).otherwise(x))
    default = F.transform(F.arrays_zip(found(source, DEFAULT, 1).alias("k"), names.alias("n")), entry)
    known = F.concat(declared, default)
    braces = F.transform(F.flatten(F.transform(found(source, BRACES), listed)), outside)
    every = F.array_distinct(F.concat(F.transform(known, lambda e: e["name"]), F.filter(braces, lambda x: x != "")))
    last = lambda n: F.get(F.reverse(F.filter(known, lambda e: e["name"] == n)), F.lit(0))["symbol_type"]
    return F.transform(every, lambda n: F.struct(n.alias("name"), F.coalesce(last(n), F.lit("unknown")).alias("symbol_type")))


def import_statements(source: Column) -> Column:
    """array<struct<specifier, names>> of imports with "from"; members that are types alone are left out, aliases count as their original."""
    values = lambda x: F.filter(F.transform(F.filter(listed(x), lambda y: ~y.startswith("type ")), original), lambda y: y != "")
    both = F.arrays_zip(found(source, GRAPH_IMPORT, 5).alias("s"), found(source, GRAPH_IMPORT, 1).alias("n"))
    return F.transform(both, lambda e: F.struct(e["s"].alias("specifier"), values(e["n"]).alias("names")))


def star_exports(source: Column) -> Column:
    return found(source, STAR_FROM)


def named_exports_from(source: Column) -> Column:
    """array<struct<specifier, names>> of lists that are exported from elsewhere."""
    values = lambda x: F.filter(F.transform(listed(x), original), lambda y: y != "")
    both = F.arrays_zip(found(source, NAMED_FROM, 2).alias("s"), found(source, NAMED_FROM, 1).alias("n"))
    return F.transform(both, lambda e: F.struct(e["s"].alias("specifier"), values(e["n"]).alias("names")))


def dependencies(source: Column, prefixes: Mapping[str, str]) -> Column:
    """Packages whose prefix a specifier begins with (the first such prefix counts), sorted and distinct."""
    package = F.lit(None).cast("string")
    rules = list(prefixes.items())

    def of(x: Column) -> Column:
        out = package
        for prefix, name in reversed(rules):
            out = F.when(x.startswith(prefix), F.lit(name)).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.filter(F.transform(found(source, PLAIN_IMPORT), of), lambda x: x.isNotNull())))


def named_path(folder: Column, specifier: Column) -> Column:
    """The path that a relative import names, without what it may leave out."""
    parts = F.aggregate(
        F.split(F.concat_ws("/", folder, specifier), "/"),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x.isin("", "."), done).when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    return F.array_join(parts, "/")


def candidate_paths(folder: Column, specifier: Column) -> Column:
    """Where a relative import may point to; the first that exists counts: file, declaration, index of a folder."""
    base = named_path(folder, specifier)
    return F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS])


def names_of_path(path: Column) -> Column:
    """array<struct<base, rank>>: under which paths an import may name a file, and how early it is then tried."""
    named = [F.when(F.endswith(path, F.lit(e)), F.struct(F.substr(path, F.lit(1), F.length(path) - len(e)).alias("base"), F.lit(k).alias("rank"))) for k, e in enumerate(ENDINGS)]
    return F.filter(F.array(*named), lambda x: x.isNotNull())
