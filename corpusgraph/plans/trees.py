"""Queries of the operators on source files, over files that are made from the table part.

Every expression that makes a file is SQL that both engines read, so query and SQL see the same text; what the SQL expects
follows from the conditions that a file is made by, not from the operator's patterns. k stands for p_partkey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, classify, features, ids, modules, syntax, text
from ..operators import enrich, loads
from .tables import query, read

NL = "chr(10)"
K = "p_partkey"


def case(of: int, values: list[str]) -> str:
    """The value for k modulo `of`, as SQL text."""
    return f"CASE {K} % {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def lines(parts: dict[str, str]) -> str:
    """Lines of a made text: those whose condition holds; "" always holds."""
    return " || ".join(f"CASE WHEN {c or '1 = 1'} THEN {t} || {NL} ELSE '' END" for t, c in parts.items())


def part(spark, sf_dir, **columns: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(K, *[f"{v} AS {k}" for k, v in columns.items()])


#: Tasks for each core where files are read by Python or by many patterns.
TASKS_A_CORE = 4


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores by their key, before files are made of them: the keys of many files are few bytes, so that
    the table's own splits would leave the work on their texts to a few tasks, or to one."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, K)


def spread_part(spark, sf_dir, **columns: str) -> DataFrame:
    """As part, with its rows spread."""
    return spread(read(spark, sf_dir, "part")).selectExpr(K, *[f"{v} AS {k}" for k, v in columns.items()])


def joined(x) -> F.Column:
    return F.array_join(x, ",")


# Naming rules: names in turn, and what each is.

TREE = [
    ("src/ui/theme.scss", "style", "scss", "style"), ("src/ui/Theme.css", "style", "scss", "style"), ("README.md", "doc", "markdown", "doc"), ("src/config.json", "config", "json", "config"),
    ("src/user.types.ts", "type", "typescript", "code"), ("src/user.type.ts", "type", "typescript", "code"), ("src/appConfig.ts", "config", "typescript", "code"), ("src/useThing.ts", "hook", "typescript", "code"),
    ("src/user.ts", "unknown", "typescript", "code"), ("src/use.ts", "unknown", "typescript", "code"), ("src/Button.tsx", "component", "tsx", "code"), ("src/services/fetch.ts", "service", "typescript", "code"),
    ("src/api/client.ts", "service", "typescript", "code"), ("src/utils/date.ts", "util", "typescript", "code"), ("src/helpers.ts", "util", "typescript", "code"), ("src/Button.TSX", "component", "tsx", "code"),
    ("src/a.test.json", "config", "json", "config"), ("src/x.d.ts", "unknown", "typescript", "code"), ("src/Button.stories.tsx", "component", "tsx", "code"), ("src/note.txt", "unknown", "unknown", "config"),
    ("node_modules/y/index.ts", "unknown", "typescript", "code"), (".json", "unknown", "unknown", "config"),
]
TREE_KEPT = {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15}
PATH = case(len(TREE), [x[0] for x in TREE])


@query(f"""SELECT {K}, {PATH} AS path, {case(len(TREE), [x[1] for x in TREE])} AS category, {case(len(TREE), [x[2] for x in TREE])} AS language, {case(len(TREE), [x[3] for x in TREE])} AS content_type,
{K} % {len(TREE)} NOT IN ({', '.join(map(str, sorted(TREE_KEPT)))}) OR {K} % 7 = 0 AS skipped FROM part""")
def classify_case(spark, sf_dir):
    rows, path = part(spark, sf_dir, path=PATH, size=f"{K} % 7"), F.col("path")
    name = classify.base_name(path)
    return rows.select(K, "path", classify.category(path, name).alias("category"), classify.language(name).alias("language"), classify.content_type(name).alias("content_type"), classify.skipped(path, F.col("size")).alias("skipped"))


PACKAGE = [
    ("src/index.ts", "barrel_export", "typescript", "code", "code"), ("src/a.types.ts", "type_definition", "typescript", "config", "code,config"), ("src/a.stories.tsx", "story", "typescript", "doc", "docs"),
    ("src/a.css", "style", "css", "code", "code"), ("src/useA.js", "hook", "javascript", "code", "code"), ("src/store/a.ts", "store_slice", "typescript", "code", "code"), ("src/cartSlice.ts", "store_slice", "typescript", "code", "code"),
    ("src/api/a.ts", "api_client", "typescript", "code", "code"), ("src/axiosInstance.ts", "api_client", "typescript", "code", "code"), ("Dockerfile", "build_config", "text", "code", "code"), ("vite.config.ts", "build_config", "typescript", "code", "code"),
    ("src/FieldRegistry.ts", "registry", "typescript", "config", "code,config"), ("src/rowMapper.ts", "mapper", "typescript", "code", "code,config"), ("src/Pagination.tsx", "sub_component", "typescript", "code", "code"),
    ("src/tokenManager.ts", "api_client", "typescript", "code", "code"), ("package.json", "json_config", "json", "config", "config"), ("README.md", "readme", "markdown", "doc", "docs"), ("src/ui/deep/Button.tsx", "component", "typescript", "code", "code"),
    ("pnpm-lock.yaml", "component", "text", "code", "code"), ("src/Old-bkp.tsx", "component", "typescript", "code", "code"), ("logo.svg", "component", "text", "code", "code"),
]
PACKAGE_PATH = case(len(PACKAGE), [x[0] for x in PACKAGE])
LAYERS = {"p0": "ui", "p1": "data", "p2": "app"}


@query(f"""SELECT {K}, {', '.join(f"{case(len(PACKAGE), [x[i] for x in PACKAGE])} AS {n}" for i, n in ((1, 'category'), (2, 'language'), (3, 'content_type'), (4, 'targets')))},
CASE {K} % {len(PACKAGE)} WHEN 5 THEN 'store' WHEN 7 THEN 'api' WHEN 17 THEN 'ui/deep' ELSE '' END AS module_path,
CASE {K} % 4 WHEN 0 THEN 'ui' WHEN 1 THEN 'data' WHEN 2 THEN 'app' ELSE 'infra' END AS layer, {K} % {len(PACKAGE)} IN (18, 19, 20) AS skipped FROM part""")
def package_rules(spark, sf_dir):
    rows, path = part(spark, sf_dir, path=PACKAGE_PATH, package=f"'p' || CAST({K} % 4 AS string)"), F.col("path")
    name = classify.base_name(path)
    category = classify.package_category(path, name)
    inside = F.when(F.startswith(path, F.lit("src/")), classify.module_path(path, F.lit("src"))).otherwise(F.lit(""))
    return rows.select(
        K, category.alias("category"), classify.package_language(name).alias("language"), classify.category_content(category).alias("content_type"), joined(classify.targets(category)).alias("targets"), inside.alias("module_path"),
        classify.layer(F.col("package"), LAYERS).alias("layer"), classify.package_skipped(name, F.lit(1)).alias("skipped"),
    )


GRAPH = [
    ("src/index.tsx", "index", "useState()"), ("src/a.types.ts", "types", "useState()"), ("src/a.ts", "hook", "const x = useState()"), ("src/hooks.ts", "hook", "x"), ("src/A.tsx", "component", "return (1)"), ("src/A.tsx", "component", "import React"),
    ("src/settings.ts", "config", "return (1)"), ("src/config.tsx", "config", "x"), ("src/Helpers.ts", "utility", "x"), ("src/a.ts", "module", "misuseOf()"), ("src/a.spec.ts", "module", "x"), ("src/a.d.ts", "module", "x"), ("dist/a.ts", "module", "x"), ("src/a.js", "module", "x"),
]


@query(f"SELECT {K}, {case(len(GRAPH), [x[1] for x in GRAPH])} AS file_type, {K} % {len(GRAPH)} >= 10 AS skipped FROM part")
def graph_rules(spark, sf_dir):
    rows, path = part(spark, sf_dir, path=case(len(GRAPH), [x[0] for x in GRAPH]), source=case(len(GRAPH), [x[2] for x in GRAPH])), F.col("path")
    return rows.select(K, classify.graph_file_type(classify.base_name(path), F.col("source")).alias("file_type"), classify.graph_skipped(path).alias("skipped"))


NAMES = ["useForm", "user", "UserListPage", "SalesDashboard", "OrderForm", "AppShell", "RouteGuard", "SetupWizard", "Button"]


@query(f"SELECT {K}, {case(9, ['hook', 'component', 'dashboard', 'dashboard', 'form', 'shell', 'shell', 'wizard', 'component'])} AS component_type FROM part")
def component_types(spark, sf_dir):
    return part(spark, sf_dir, name=case(9, NAMES)).select(K, classify.component_type(F.col("name")).alias("component_type"))


# Imports and exports.

SOURCE = lines({
    """'import { Alpha, type Beta, Gamma as G } from "@x/ui";'""": f"{K} % 2 = 0",
    """'import type { Delta } from "@x/data";'""": f"{K} % 3 = 0",
    """'import "./style.css";'""": f"{K} % 5 = 0",
    """'import * as all from "@x/data/deep";'""": f"{K} % 7 = 0",
    """'import Main, { one } from "./main";'""": f"{K} % 4 = 1",
    """'export * from "./stars";'""": f"{K} % 3 = 1",
    """'export { near as far, here } from "./list";'""": f"{K} % 5 = 2",
    """'export const first = 1;'""": "",
    """'export default function Page() { return first }'""": f"{K} % 2 = 1",
    """'export async function later() {}'""": f"{K} % 3 = 2",
    """'export abstract class Base {}'""": f"{K} % 4 = 2",
    """'export interface Props {}'""": f"{K} % 5 = 1",
    """'export enum Kind { A }'""": f"{K} % 7 = 1",
    """'export { second, third as fourth };'""": f"{K} % 2 = 0",
})


def when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN '{value}' END"


@query(f"""SELECT {K}, concat_ws(',', {when(f'{K} % 2 = 0', '@x/ui')}, {when(f'{K} % 3 = 0', '@x/data')}, {when(f'{K} % 5 = 0', './style.css')}, {when(f'{K} % 7 = 0', '@x/data/deep')},
{when(f'{K} % 4 = 1', './main')}, {when(f'{K} % 3 = 1', './stars')}, {when(f'{K} % 5 = 2', './list')}) AS specifiers,
concat_ws(',', {when(f'{K} % 2 = 0', 'Alpha,Beta')}, {when(f'{K} % 3 = 0', 'Delta')}, {when(f'{K} % 2 = 0', 'Gamma')}) AS symbols,
concat_ws(',', {when(f'{K} % 3 = 0', '@x/data')}, {when(f'{K} % 7 = 0', '@x/data/deep')}, {when(f'{K} % 2 = 0', '@x/ui')}) AS packages,
concat_ws(',', {when(f'{K} % 2 = 0', 'Alpha,Beta')}, {when(f'{K} % 3 = 0', 'Delta')}, {when(f'{K} % 2 = 0', 'Gamma as G')}) AS loose_symbols,
concat_ws(',', 'first', {when(f'{K} % 2 = 1', 'Page')}, {when(f'{K} % 3 = 2', 'later')}, {when(f'{K} % 5 = 1', 'Props')}, {when(f'{K} % 7 = 1', 'Kind')}, {when(f'{K} % 5 = 2', 'far,here')}, {when(f'{K} % 2 = 0', 'second,fourth')}) AS exports
FROM part""")
def file_imports(spark, sf_dir):
    s = F.col("source")
    scoped, loose = modules.scoped_imports(s, "@x/"), modules.scoped_imports(s, "@x/", loose=True)
    # `from` is a word of its own in the pattern of specifiers, so exports from elsewhere count too
    found = part(spark, sf_dir, source=SOURCE).select(K, joined(modules.imports(s)).alias("specifiers"), scoped.alias("a"), loose.alias("b"), joined(modules.exports(s)).alias("exports"))
    return found.select(K, "specifiers", joined("a.symbols").alias("symbols"), joined("a.packages").alias("packages"), joined("b.symbols").alias("loose_symbols"), "exports")


EXPORTED = [
    ("1 = 1", "first", "constant"), (f"{K} % 2 = 1", "Page", "function"), (f"{K} % 4 = 2", "Base", "class"), (f"{K} % 5 = 1", "Props", "interface"), (f"{K} % 7 = 1", "Kind", "enum"),
    (f"{K} % 2 = 0", "second", "unknown"), (f"{K} % 2 = 0", "fourth", "unknown"),
]


@query(" UNION ALL ".join(f"SELECT {K}, '{n}' AS name, '{t}' AS symbol_type FROM part WHERE {c}" for c, n, t in EXPORTED))
def typed_exports(spark, sf_dir):
    return part(spark, sf_dir, source=SOURCE).select(K, F.explode(modules.typed_exports(F.col("source"))).alias("e")).select(K, "e.name", "e.symbol_type")


STATEMENTS = [
    (f"{K} % 2 = 0", "import", "@x/ui", "Alpha,Gamma"), (f"{K} % 3 = 0", "import", "@x/data", "Delta"), (f"{K} % 7 = 0", "import", "@x/data/deep", ""), (f"{K} % 4 = 1", "import", "./main", ""),
    (f"{K} % 3 = 1", "star", "./stars", ""), (f"{K} % 5 = 2", "list", "./list", "near,here"),
]


@query(" UNION ALL ".join(f"SELECT {K}, '{k}' AS kind, '{s}' AS specifier, '{n}' AS names FROM part WHERE {c}" for c, k, s, n in STATEMENTS))
def import_statements(spark, sf_dir):
    files = part(spark, sf_dir, content=SOURCE, package_name="'p'", rel_path=f"CAST({K} AS string)", path="'x'")
    return loads.statements(files).select(F.split_part("file", F.lit("::"), F.lit(2)).cast("long").alias(K), "kind", "specifier", joined("names").alias("names"))


@query(f"""SELECT {K}, concat_ws(',', CASE WHEN {K} % 2 = 0 THEN 'a' END, CASE WHEN {K} % 3 = 0 THEN 'b$,c' END) AS exports,
concat_ws(',', CASE WHEN {K} % 5 = 0 THEN '@x/data' END, CASE WHEN {K} % 2 = 0 THEN '@x/ui' END) AS dependencies FROM part""")
def chunk_exports(spark, sf_dir):
    segment = lines({"'use a here'": f"{K} % 2 = 0", "'use b$c b$ here'": f"{K} % 3 = 0", "'alphabet bc'": "", """'import "@x/ui/button"'""": f"{K} % 2 = 0", """'import "@x/data"'""": f"{K} % 5 = 0", """'import x from "@x/ui"'""": f"{K} % 2 = 0", """'import "react"'""": ""})
    rows = part(spark, sf_dir, segment=segment)
    # a word ends at a boundary: "b$" has one before "c", not before a blank
    names = modules.exports_within(F.col("segment"), F.array(*[F.lit(x) for x in ("a", "b$", "c", "here$", "alpha")]))
    return rows.select(K, joined(names).alias("exports"), joined(modules.dependencies(F.col("segment"), {"@x/ui": "@x/ui", "@x/data": "@x/data"})).alias("dependencies"))


# Examples.

FLAG_LINES = {
    "has_search": ("'hasSearch : TRUE,'", f"{K} % 2 = 0"), "has_filters": ("'filters: [],'", f"{K} % 3 <> 1"), "has_actions": ("'actions = [],'", f"{K} % 5 = 0"), "has_list_view": ("'listProps,'", f"{K} % 7 = 0"),
    "has_mode_switch": ("'modeSwitchProps,'", f"{K} % 4 = 0"), "has_pagination": ("'paginationParams,'", f"{K} % 11 = 0"), "has_advance_filters": ("'advancedFilterProps,'", f"{K} % 13 = 0"),
    "has_api_integration": ("'apiResponseMapper,'", f"{K} % 5 = 1"), "has_row_selection": ("'rowSelection,'", f"{K} % 8 = 3"),
    "has_sections": ("'sections: [],'", f"{K} % 2 = 1"), "has_nested_groups": ("""'type: "group",'""", f"{K} % 5 = 2"), "has_custom_validators": ("'customValidators = { check: (), other: () },'", f"{K} % 3 = 0"),
    "has_custom_component": ("""'type: "custom",'""", f"{K} % 7 = 2"), "has_conditional_visibility": ("'visibleIf,'", f"{K} % 11 = 1"), "has_conditional_validation": ("'requiredIf,'", f"{K} % 13 = 1"),
    "has_dependent_fields": ("'depends: x,'", f"{K} % 4 = 1"), "has_file_upload": ("""'type: "fileUpload",'""", f"{K} % 8 = 1"),
}
SELECT, RANGE, TEXT = f"{K} % 3 = 2", f"{K} % 7 = 3", f"{K} % 5 = 3"
IS_DASHBOARD, IS_FORM = f"{K} % 9 IN (0, 1, 2, 8)", f"{K} % 9 IN (3, 4, 5)"
EXAMPLE = lines(
    {"'const a: DashboardConfig = {'": f"{K} % 9 IN (0, 1, 2)", "'const b: JSONFormSchema = {'": IS_FORM}
    | dict(FLAG_LINES.values())
    | {"""'type: "select",'""": SELECT, """'type: "date-range",'""": RANGE, """'type : "text",'""": TEXT, "'useState(); useEffect();'": f"{K} % 6 = 0", "'import { B } from \"@x/kit\";'": f"{K} % 10 = 0", "'a: 1, b: 2, c: 3, d: 4, e: 5, f: 6, g: 7, h: 8, i: 9,'": f"{K} % 4 = 3", "'a: 1, b: 2, c: 3, d: 4, e: 5, f: 6, g: 7, h: 8, i: 9, j: 0, k: 1,'": f"{K} % 8 = 7"}
)
FILE_NAME = case(5, ["types.ts", "config.ts", "Page.tsx", "page.ts", "Row.tsx"])
EXAMPLE_PATH = f"CASE WHEN {K} % 9 = 8 THEN 'x/Dashboard01/' ELSE 'x/Sample/' END || {FILE_NAME}"
PATTERN_SQL = f"CASE WHEN {IS_DASHBOARD} THEN 'ConfigurableDashboard' WHEN {IS_FORM} THEN 'ConfigurableForm' ELSE 'unknown' END"
MAIN = f"{K} % 9 < 6"
ROLE_SQL = f"CASE WHEN {K} % 5 = 0 THEN 'types' WHEN {K} % 5 = 1 THEN 'config' WHEN {K} % 10 = 0 AND NOT {MAIN} THEN 'custom_component' WHEN {MAIN} THEN 'page_component' WHEN {K} % 5 IN (2, 4) THEN 'page_component' ELSE 'unknown' END"
DASHBOARD_NAMES, FORM_NAMES = list(features.DASHBOARD_FLAGS), list(features.FORM_FLAGS)
FLAG_SQL = {n: f"({IS_DASHBOARD} AND {FLAG_LINES[n][1]})" for n in DASHBOARD_NAMES} | {n: f"({IS_FORM} AND {FLAG_LINES[n][1]})" for n in FORM_NAMES}
POINTS = " + ".join(f"CAST({c} AS INTEGER)" for c in FLAG_SQL.values())
COLONS = f"(length({EXAMPLE}) - length(replace({EXAMPLE}, ':', '')))"


def grade(score: str, sign: str, top: int, middle: int) -> str:
    return f"CASE WHEN {score} {sign} {top} THEN 'complex' WHEN {score} {sign} {middle} THEN 'medium' ELSE 'simple' END"


COMPLEXITY_SQL = f"CASE {ROLE_SQL} WHEN 'types' THEN {grade(COLONS, '>', 20, 10)} WHEN 'config' THEN {grade(POINTS, '>=', 4, 2)} WHEN 'unknown' THEN 'simple' ELSE CASE WHEN {K} % 6 = 0 THEN 'medium' ELSE 'simple' END END"
FILTERS_SQL = f"concat_ws('/', CASE WHEN {FLAG_SQL['has_filters']} AND {SELECT} THEN 'select' END, CASE WHEN {FLAG_SQL['has_filters']} AND {RANGE} THEN 'date-range' END, CASE WHEN {FLAG_SQL['has_filters']} AND {TEXT} THEN 'text' END)"
FIELDS = [("custom", FLAG_LINES["has_custom_component"][1]), ("date-range", RANGE), ("fileUpload", FLAG_LINES["has_file_upload"][1]), ("select", SELECT), ("text", TEXT)]
FIELDS_SQL = "[x FOR x IN [" + ", ".join(f"CASE WHEN {IS_FORM} AND {c} THEN '{n}' END" for n, c in FIELDS) + "] IF x IS NOT NULL]"
PHRASE = lambda n, t: f"CASE WHEN {FLAG_SQL[n]} THEN '{t}' END"
DASHBOARD_WORDS = [("has_search", "with search"), ("has_filters", None), ("has_advance_filters", "with advanced filter modal"), ("has_actions", "with bulk actions"), ("has_list_view", "with card/list view toggle"), ("has_mode_switch", "with table/grid mode switch"), ("has_pagination", "with pagination"), ("has_row_selection", "with row selection"), ("has_api_integration", "with API integration")]
FORM_WORDS = [("has_sections", "with sections"), ("has_nested_groups", "with nested group sections"), ("has_custom_validators", "with custom validators (check, other)"), ("has_custom_component", "with custom rendered field"), ("has_conditional_visibility", "with conditional visibility (visibleIf)"), ("has_conditional_validation", "with conditional required (requiredIf)"), ("has_dependent_fields", "with dependent fields"), ("has_file_upload", "with file upload")]
WITH_FILTERS = f"CASE WHEN {FLAG_SQL['has_filters']} THEN CASE WHEN {FILTERS_SQL} <> '' THEN 'with ' || {FILTERS_SQL} || ' filters' ELSE 'with filters' END END"
BODY_SQL = f"""CASE WHEN {IS_DASHBOARD} THEN concat_ws(', ', 'Dashboard', {', '.join(WITH_FILTERS if t is None else PHRASE(n, t) for n, t in DASHBOARD_WORDS)})
WHEN {IS_FORM} THEN concat_ws(', ', 'Form', CASE WHEN len({FIELDS_SQL}) > 0 THEN 'with ' || array_to_string({FIELDS_SQL}[1:4], ', ') || ' fields' END, {', '.join(PHRASE(n, t) for n, t in FORM_WORDS)}) ELSE 'unknown' END"""
USE_SQL = f"'E1' || CASE {ROLE_SQL} WHEN 'page_component' THEN ' page component: ' WHEN 'config' THEN ' config: ' WHEN 'types' THEN ' type definitions: ' WHEN 'custom_component' THEN ' custom component (S): ' ELSE ': ' END || {BODY_SQL}"


def example_rows(spark, sf_dir, loose: bool = False) -> DataFrame:
    rows = spread_part(spark, sf_dir, content=EXAMPLE, path=EXAMPLE_PATH, file_name=FILE_NAME, example_id=f"'E' || CAST({K} % 50 AS string)", example_group=f"'G' || CAST({K} % 50 AS string)")
    return loads.analysed(rows, "@x/kit", loose)


@query(f"""SELECT {K}, {PATTERN_SQL} AS pattern, {ROLE_SQL} AS file_role, {COMPLEXITY_SQL} AS complexity, {', '.join(f'{c} AS {n}' for n, c in FLAG_SQL.items())},
{FILTERS_SQL} AS filter_types, array_to_string({FIELDS_SQL}, ',') AS field_types, CASE WHEN {FLAG_SQL['has_custom_validators']} THEN 'check,other' ELSE '' END AS validators, {USE_SQL} AS use_case FROM part""")
def example_features(spark, sf_dir):
    rows = example_rows(spark, sf_dir)
    f = F.struct(*features.FLAGS, *features.LISTS)
    use = features.use_case(F.lit("E1"), F.col("pattern"), F.col("file_role"), f, F.lit("S"))
    return rows.select(K, "pattern", "file_role", "complexity", *features.FLAGS, F.array_join("filter_types", "/").alias("filter_types"), joined("field_types_used").alias("field_types"), joined("custom_validator_names").alias("validators"), use.alias("use_case"))


LOOSE_FLAGS = FLAG_SQL | {"has_actions": "FALSE"}
LOOSE_POINTS = " + ".join(f"CAST({c} AS INTEGER)" for n, c in LOOSE_FLAGS.items() if n not in ("has_search", "has_api_integration", "has_row_selection"))
LOOSE_MAIN = f"{K} % 9 < 0"  # neither main component is named by these files
LOOSE_ROLE = f"CASE WHEN {K} % 5 = 0 THEN 'types' WHEN {K} % 5 = 1 THEN 'config' WHEN {K} % 10 = 0 THEN 'custom_component' WHEN {K} % 5 IN (2, 4) THEN 'page_component' ELSE 'config' END"
LOOSE_COMPLEXITY = f"CASE {LOOSE_ROLE} WHEN 'types' THEN {grade(COLONS, '>', 15, 8)} WHEN 'config' THEN {grade(f'({LOOSE_POINTS})', '>=', 3, 1)} WHEN 'custom_component' THEN 'medium' ELSE 'simple' END"


@query(f"""SELECT {K}, {PATTERN_SQL} AS pattern, {LOOSE_ROLE} AS file_role, {LOOSE_COMPLEXITY} AS complexity, {', '.join(f'{c} AS {n}' for n, c in LOOSE_FLAGS.items())},
concat_ws('/', CASE WHEN {IS_DASHBOARD} AND {SELECT} THEN 'select' END, CASE WHEN {IS_DASHBOARD} AND {RANGE} THEN 'date_range' END, CASE WHEN {FLAG_SQL['has_filters']} AND {TEXT} THEN 'text' END) AS filter_types,
concat_ws(',', {', '.join(f"CASE WHEN {IS_FORM} AND {c} THEN '{n}' END" for n, c in FIELDS if n != 'date-range')}) AS field_types FROM part""")
def example_features_loose(spark, sf_dir):
    rows = example_rows(spark, sf_dir, loose=True)
    return rows.select(K, "pattern", "file_role", "complexity", *features.FLAGS, F.array_join("filter_types", "/").alias("filter_types"), joined("field_types_used").alias("field_types"))


SET = f"'E' || CAST({K} % 50 AS VARCHAR)"
ANALYSED = f"a AS (SELECT {K}, {SET} AS example_id, {K} || {FILE_NAME} AS file_name, {PATTERN_SQL} AS pattern, {COMPLEXITY_SQL} AS complexity, {', '.join(f'{c} AS {n}' for n, c in FLAG_SQL.items())} FROM part)"


@query(f"""WITH {ANALYSED}, n AS (SELECT example_id, pattern, count(*) AS n, min(file_name) AS f FROM a WHERE pattern <> 'unknown' GROUP BY ALL),
p AS (SELECT example_id, pattern FROM n QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY n DESC, f) = 1)
SELECT a.example_id, coalesce(any_value(p.pattern), 'unknown') AS pattern, list_extract(['simple', 'medium', 'complex'], max(CASE complexity WHEN 'complex' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) + 1) AS complexity,
{', '.join(f'bool_or({n}) AS {n}' for n in FLAG_SQL)}, count(DISTINCT file_name) AS files FROM a LEFT JOIN p ON a.example_id = p.example_id GROUP BY a.example_id""")
def example_sets(spark, sf_dir):
    out = loads.examples(example_rows(spark, sf_dir).withColumn("file_name", F.concat(F.col(K).cast("string"), "file_name")))
    return out.select("example_id", "pattern", "complexity", *features.FLAGS, F.size("files").cast("long").alias("files"))


@query(f"""WITH {ANALYSED}, f AS (SELECT example_id, {', '.join(f'bool_or({n}) AS {n}' for n in FLAG_SQL)} FROM a GROUP BY example_id)
{' UNION ALL '.join(f"SELECT example_id AS src, '{n}' AS dst FROM f WHERE {n}" for n in FLAG_SQL)}""")
def example_feature_edges(spark, sf_dir):
    return loads.example_graph(example_rows(spark, sf_dir), "@x/ui", features.FIELD_TYPES)["example_exhibits_feature"]


@query(f"""SELECT {K}, sha256('[E1 / ' || {ROLE_SQL} || '] ' || {PATTERN_SQL} || ' example — G' || {NL} || 'File: ' || {FILE_NAME} || ' | Complexity: ' || {COMPLEXITY_SQL} || {NL} || 'Use case: ' || {USE_SQL.replace("(S)", "(n)")} || {NL}
|| CASE WHEN {POINTS} > 0 THEN 'Features: ' || concat_ws(', ', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in FLAG_SQL.items())}) || {NL} ELSE '' END
|| CASE WHEN {K} % 10 = 0 THEN 'Imports: B' || {NL} ELSE '' END || 'Exports: ' || {NL} || '---' || {NL} || {EXAMPLE}) AS digest FROM part""")
def example_chunks(spark, sf_dir):
    rows = example_rows(spark, sf_dir)
    f, source = F.struct(*features.FLAGS, *features.LISTS), F.col("content")
    use = features.use_case(F.lit("E1"), F.col("pattern"), F.col("file_role"), f, F.lit("n"))
    row = {"example_id": F.lit("E1"), "group": F.lit("G"), "name": F.col("file_name"), "role": F.col("file_role"), "pattern": F.col("pattern"), "complexity": F.col("complexity"), "use_case": use, "features": f, "symbols": modules.scoped_imports(source, "@x/")["symbols"], "exports": modules.exports(source), "source": source}
    return rows.select(K, ids.text_hash(features.example_text(row)).alias("digest"))


# The code graph: three files for each part.

FILES = f"""SELECT {K}, f, 'p' || CAST({K} % 5 AS STRING) AS package_name, 'packages/p' || CAST({K} % 5 AS STRING) || '/' || rel AS path, rel AS rel_path, content FROM (
SELECT {K}, f, 'src/m' || CAST({K} AS STRING) || '/' || CASE f WHEN 0 THEN 'index.ts' WHEN 1 THEN 'Thing.tsx' ELSE CASE {K} % 2 WHEN 0 THEN 'helper.ts' ELSE 'helper/index.ts' END END AS rel,
CASE f WHEN 0 THEN 'export * from "./Thing";' || chr(10) || 'export {{ assist, more as less }} from "./helper";' || chr(10)
WHEN 1 THEN 'import {{ assist as a, type T }} from "./helper";' || chr(10) || 'import {{ Alpha }} from "@x/p' || CAST(({K} + 1) % 5 AS STRING) || '/sub";' || chr(10) || 'import gone from "../none";' || chr(10) || 'export const Thing' || CAST({K} AS STRING) || ' = () => {{ return (1) }};' || chr(10)
ELSE 'import {{ x }} from "../m' || CAST({K} + 5 AS STRING) || '/Thing";' || chr(10) || 'export function assist() {{}}' || chr(10) END AS content FROM"""
FILES_SQL = FILES + f" (SELECT {K}, unnest([0, 1, 2]) AS f FROM part))"
ID = "'@x/' || package_name || '::' || rel_path"


def graph_files(spark, sf_dir) -> DataFrame:
    read(spark, sf_dir, "part").select(K, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("f")).createOrReplaceTempView("_made_files")
    out = spark.sql(FILES + " _made_files)")
    return out.withColumn("package_name", F.concat(F.lit("@x/"), "package_name"))


def code_tables(spark, sf_dir) -> dict[str, DataFrame]:
    files = graph_files(spark, sf_dir)
    components = read(spark, sf_dir, "part").where(f"{K} % 3 = 0").selectExpr(f"'c' || CAST({K} AS STRING) AS id", f"'Thing' || CAST({K} AS STRING) AS name")
    return loads.code_graph(files, files.select("package_name").distinct(), components, "@x/")


@query(f"WITH f AS ({FILES_SQL}) SELECT {ID} AS id, rel_path, CASE f WHEN 0 THEN 'index' WHEN 1 THEN 'component' ELSE CASE {K} % 2 WHEN 0 THEN 'utility' ELSE 'index' END END AS file_type FROM f")
def source_files(spark, sf_dir):
    return code_tables(spark, sf_dir)["source_file"].select("id", "rel_path", "file_type")


@query(f"WITH f AS ({FILES_SQL}) SELECT '@x/' || package_name || '::' || CASE f WHEN 1 THEN 'Thing' || {K} ELSE 'assist' END AS id, CASE f WHEN 1 THEN 'constant' ELSE 'function' END AS symbol_type, count(*) AS files FROM f WHERE f > 0 GROUP BY ALL")
def exported_symbols(spark, sf_dir):
    t = code_tables(spark, sf_dir)
    n = t["exports_symbol"].groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("files"))
    return t["exported_symbol"].join(n, "id").select("id", "symbol_type", "files")


@query(f"""WITH f AS ({FILES_SQL}) SELECT a.id AS src, b.id AS dst, names AS names FROM (
SELECT {ID} AS id, {K}, f.f AS g, CASE f.f WHEN 2 THEN {K} + 5 ELSE {K} END AS to_key, CASE f.f WHEN 2 THEN 1 ELSE 2 END AS to_file, CASE f.f WHEN 0 THEN 'assist,more' WHEN 1 THEN 'assist' ELSE 'x' END AS names FROM f) a
JOIN (SELECT {ID} AS id, {K}, f.f AS h FROM f) b ON b.{K} = a.to_key AND b.h = a.to_file WHERE g <> 2 OR a.{K} % 2 = 0""")
def import_edges(spark, sf_dir):
    return code_tables(spark, sf_dir)["imports_from"].select("src", "dst", joined("import_specifiers").alias("names"))


@query(f"WITH f AS ({FILES_SQL}) SELECT {ID} AS src, '@x/p' || (({K} + 1) % 5) AS dst, 'Alpha' AS names FROM f WHERE f = 1 AND EXISTS (SELECT 1 FROM part p WHERE p.{K} % 5 = (f.{K} + 1) % 5)")
def package_edges(spark, sf_dir):
    return code_tables(spark, sf_dir)["imports_package"].select("src", "dst", joined("import_specifiers").alias("names"))


@query(f"WITH f AS ({FILES_SQL}) SELECT a.src, b.dst FROM (SELECT {ID} AS src, {K} FROM f WHERE f = 0) a JOIN (SELECT {ID} AS dst, {K} FROM f WHERE f = 1) b USING ({K})")
def re_export_edges(spark, sf_dir):
    return code_tables(spark, sf_dir)["re_exports_from"].select("src", "dst")


@query(f"SELECT '@x/p' || ({K} % 5) || '::Thing' || {K} AS src, 'c' || {K} AS dst FROM part WHERE {K} % 3 = 0")
def symbol_bridge(spark, sf_dir):
    return code_tables(spark, sf_dir)["symbol_linked_to_component"].select("src", "dst")


# Knowledge on packages: regions as packages, nations as components.


def knowledge_rows(spark, sf_dir) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name, none = F.col("n_name"), F.array().cast("array<string>")
    mates = n.select((F.col("n_nationkey") - 1).alias("k"), F.col("n_name").alias("next"))
    return nations.join(mates, F.col("k") == F.col("n_nationkey"), "left").select(
        F.col("r_name").alias("import_path"), F.lit("").alias("package_description"), name.alias("name"), F.lit("d").alias("description"), none.alias("when_to_use"), none.alias("do_not_use_when"),
        F.array_compact(F.array(F.col("next"), F.lit("Nowhere"))).alias("internally_uses"), F.when(F.col("n_nationkey") % 2 == 0, F.array_compact(F.array(F.concat("next", F.lit(" (for x)"))))).otherwise(none).alias("hooks"),
    )


def knowledge(spark, sf_dir) -> dict[str, DataFrame]:
    rows = knowledge_rows(spark, sf_dir)
    types = spark.createDataFrame([("t1", "T", "", ["a"])], "id string, name string, description string, required_fields array<string>")
    uses = spark.createDataFrame([("x", "t1", "config_prop")], "src string, dst string, role string")
    return loads.knowledge_graph(rows, types, uses, {"x": ["has_search"]}, {"x": ["text", "email"]}, {"has_search": "Search"})


ATLAS = "c AS (SELECT n_nationkey AS k, n_name, r_name || '::' || n_name AS id, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {ATLAS} SELECT a.id AS src, b.id AS dst, 'internally_uses' AS kind FROM c a JOIN c b ON b.k = a.k + 1 UNION ALL SELECT id, r_name, 'belongs_to' FROM c UNION ALL SELECT a.id, b.id, 'uses_hook' FROM c a JOIN c b ON b.k = a.k + 1 WHERE a.k % 2 = 0 AND b.n_name NOT LIKE '% %'")
def knowledge_edges(spark, sf_dir):
    t = knowledge(spark, sf_dir)
    parts = [t[k].select("src", "dst", F.lit(k).alias("kind")) for k in ("internally_uses", "belongs_to", "uses_hook")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {ATLAS}, l AS (SELECT a.r_name, a.n_name, '  • ' || a.n_name || {NL} || '    d' || CASE WHEN a.k % 2 = 0 AND b.k IS NOT NULL THEN {NL} || '    data_hook: ' || b.n_name || ' (for x)' ELSE '' END || {NL} || '    internally_uses: ' || CASE WHEN b.k IS NOT NULL THEN b.n_name || ', ' ELSE '' END || 'Nowhere' AS t FROM c a LEFT JOIN c b ON b.k = a.k + 1)
SELECT r_name AS import_path, sha256('[' || r_name || ']' || {NL} || '  ' || {NL} || {NL} || string_agg(t, {NL} ORDER BY n_name) || {NL}) AS digest FROM l GROUP BY r_name""")
def context_texts(spark, sf_dir):
    return loads.context_text(knowledge_rows(spark, sf_dir)).select("import_path", ids.text_hash(F.col("text")).alias("digest"))


# Chunks.

MADE_CODE = lines({
    "'// about the file'": f"{K} % 2 = 0", """'import { a } from "b";'""": f"{K} % 3 = 0", "'export const Card = ({ title, size = 1, ...rest }: Props) => { return title };'": "", "'stray();'": f"{K} % 5 = 0",
    "'export function useCard() { const s = \"}\"; return s }'": f"{K} % 2 = 1", "'interface Props extends Base<X, Y>, Other { title: string; size?: number }'": f"{K} % 3 = 1", "'export enum Kind { A = 1, B }'": f"{K} % 7 = 0", "'class Store { get() {} }'": f"{K} % 11 = 0", "'const limit = 3'": f"{K} % 4 = 0",
})
DECLARED = [("1 = 1", "Card", "function", "function_component", "title,size,...rest"), (f"{K} % 2 = 1", "useCard", "hook", "hook", ""), (f"{K} % 3 = 1", "Props", "interface", "interface", ""), (f"{K} % 7 = 0", "Kind", "enum", "enum", ""), (f"{K} % 11 = 0", "Store", "class", "class", ""), (f"{K} % 4 = 0", "limit", "variable", "utility", "")]


@query(" UNION ALL ".join(f"SELECT {K}, '{n}' AS name, '{c}' AS type, '{p}' AS props, {'TRUE' if n in ('Card', 'useCard') else 'FALSE'} AS exported FROM part WHERE {w}" for w, n, _, c, p in DECLARED))
def component_chunks(spark, sf_dir):
    return spread_part(spark, sf_dir, source=MADE_CODE).select(K, F.explode(syntax.components(F.col("source"), F.lit("file"))).alias("x")).select(K, "x.name", "x.type", joined("x.props").alias("props"), (F.size("x.exports") > 0).alias("exported"))


@query(f"""SELECT {K}, 'Props' AS name, 'interface' AS type, 'title,size' AS fields, 'Base<X,Y>,Other' AS extends FROM part WHERE {K} % 3 = 1 UNION ALL SELECT {K}, 'Kind', 'enum', 'A,B', '' FROM part WHERE {K} % 7 = 0""")
def type_chunks(spark, sf_dir):
    return spread_part(spark, sf_dir, source=MADE_CODE).select(K, F.explode(syntax.types(F.col("source"))).alias("x")).select(K, "x.name", "x.type", joined("x.fields").alias("fields"), joined("x.extends").alias("extends"))


MARKDOWN = f"'---' || {NL} || 'x: 1' || {NL} || '---' || {NL} || " + lines({"'before'": "", f"'# A' || {NL} || 'a'": f"{K} % 4 <> 3", f"'## B' || {NL} || 'b'": f"{K} % 3 = 0 AND {K} % 4 <> 3", f"'### C' || {NL} || 'c'": f"{K} % 2 = 0 AND {K} % 4 <> 3", f"'## D' || {NL} || 'd'": f"{K} % 5 = 0 AND {K} % 4 <> 3"})
HEADED = [("A", 1, "", "'A'", f"{K} % 4 <> 3"), ("B", 2, "A", "'A > B'", f"{K} % 3 = 0 AND {K} % 4 <> 3"), ("C", 3, None, f"CASE WHEN {K} % 3 = 0 THEN 'A > B > C' ELSE 'A > C' END", f"{K} % 2 = 0 AND {K} % 4 <> 3"), ("D", 2, "A", "'A > D'", f"{K} % 5 = 0 AND {K} % 4 <> 3")]


@query(" UNION ALL ".join(f"SELECT {K}, '{t}' AS title, {lv}::BIGINT AS level, {path} AS path, sha256('{'#' * lv} {t}' || {NL} || '{t.lower()}') AS digest FROM part WHERE {w}" for t, lv, _, path, w in HEADED) + f" UNION ALL SELECT {K}, 'notes', 0, '', sha256('before') FROM part WHERE {K} % 4 = 3")
def markdown_sections(spark, sf_dir):
    out = chunking.markdown_sections(part(spark, sf_dir, body=MARKDOWN, name="'notes'"), K, "body", "name")
    return out.select(K, "title", F.col("level").cast("long").alias("level"), "path", ids.text_hash(F.col("text")).alias("digest"))


@query(f"""SELECT {K}, sha256('[' || CASE WHEN {K} % 2 = 0 THEN 'function: ' || p_name ELSE 'module' END || '] [' || p_brand || ' / ' || p_type || ']' || {NL} || 'Package: ' || p_brand || ' | File: ' || {K} || '.ts' || {NL}
|| CASE WHEN {K} % 3 = 0 THEN 'Use when: u | v' || {NL} ELSE '' END || CASE WHEN {K} % 5 = 0 THEN 'Imports: 1, 2, 3, 4, 5, 6, 7, 8' || {NL} ELSE '' END || CASE WHEN {K} % 2 = 0 THEN 'Exports: a' || {NL} ELSE '' END || '---' || {NL} || p_name) AS digest FROM part""")
def embed_text_header(spark, sf_dir):
    k = F.col(K)
    array = lambda c, *x: F.when(c, F.array(*[F.lit(v) for v in x])).otherwise(F.array().cast("array<string>"))
    even = k % 2 == 0
    x = chunking.embed_text(
        F.col("p_name"), F.when(even, "function").otherwise("module"), F.when(even, F.col("p_name")).otherwise(""), F.col("p_brand"), F.col("p_type"), F.concat(k.cast("string"), F.lit(".ts")),
        array(k % 5 == 0, *map(str, range(1, 11))), array(even, "a"), array(k % 3 == 0, "u", "v"), array(F.lit(False), "w"),
    )
    return read(spark, sf_dir, "part").select(K, ids.text_hash(x).alias("digest"))


# Text functions on made texts.

DOC = lines({"'/**' || chr(10) || ' * Shows a list of rows.' || chr(10) || ' */'": f"{K} % 3 = 0", "'/** short */'": f"{K} % 3 = 1", "'// a line about the code'": f"{K} % 2 = 0", "'// tiny'": f"{K} % 2 = 1", "'```ts' || chr(10) || 'x' || chr(10) || '```'": f"{K} % 5 = 0", "'```js' || chr(10) || 'x' || chr(10) || '```'": f"{K} % 7 < 2", "'```' || chr(10) || 'x' || chr(10) || '```'": f"{K} % 4 = 0"})


@query(f"""SELECT {K}, CASE WHEN {K} % 3 = 0 THEN 'Shows a list of rows' WHEN {K} % 2 = 0 THEN 'a line about the code' ELSE 'code: ' || p_name END AS summary,
(CASE WHEN {K} % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN {K} % 7 < 2 THEN 1 ELSE 0 END + CASE WHEN {K} % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS blocks, CASE WHEN {K} % 7 < 2 THEN 'js' WHEN {K} % 5 = 0 THEN 'ts' ELSE '' END AS block_language FROM part""")
def chunk_summaries(spark, sf_dir):
    blocks = text.code_blocks(F.col("doc"))
    return part(spark, sf_dir, doc=DOC, p_name="p_name").select(K, text.summary(F.col("doc"), F.col("p_name"), F.lit("code")).alias("summary"), blocks["n"].cast("long").alias("blocks"), blocks["language"].alias("block_language"))


TITLES = [("8. Material Issue", "Material Issue"), ("Step 1 – How it is Made", "How it is Made"), ("phase 2 - Load", "Load"), ("Stage 3 - Ship – Final", "Ship"), ("Job (Final Document)", "Job"), ("8.1 - Foo", "1 - Foo"), ("Plain", "Plain"), ("Use (Against Job) – Final", "Use"), ("Name - version 2", "Name")]


@query(f"SELECT {K}, {case(len(TITLES), [x[1] for x in TITLES])} AS name, 'Hello ' || p_name || ', {{b}} of ' || p_brand AS filled, round(({K} * 1000 + 7) / 1e6 * 0.13, 6) AS cost FROM part")
def module_names(spark, sf_dir):
    rows = part(spark, sf_dir, title=case(len(TITLES), [x[0] for x in TITLES]), p_name="p_name", p_brand="p_brand")
    filled = text.filled(F.lit("Hello {a}, {b} of {c}"), {"a": F.col("p_name"), "c": F.col("p_brand")})
    return rows.select(K, text.module_name(F.col("title")).alias("name"), filled.alias("filled"), F.round(text.embedding_cost(F.col(K) * 1000 + 7), 6).alias("cost"))


POSITION = case(5, ["Intro text. Stock  Ledger begins", "Intro text. stock ledger begins", "Intro text. STOCK" + "   LEDGER begins", "nothing here", "Stock Ledger begins"])


@query(f"SELECT {K}, CASE {K} % 5 WHEN 0 THEN 13 WHEN 1 THEN 13 WHEN 2 THEN 13 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS position, {case(5, ['Stock  Ledger ', 'stock ledger ', 'STOCK   LEDGER ', 'nothing here', 'Stock Ledger '])} AS section FROM part")
def heading_positions(spark, sf_dir):
    rows = part(spark, sf_dir, body=POSITION)
    section = text.section_between(F.col("body"), F.lit("Stock Ledger"), F.lit("begins"))
    return rows.select(K, text.heading_position(F.col("body"), F.lit("Stock Ledger")).cast("long").alias("position"), section.alias("section"))


QUOTED = [("true", 1), ("True", 0), ("007", 1), ("7", 1), ("-x", 1), ("1.5e3", 1), ("plain words", 0), (" a", 1), ("a,b", 1), ("a:b", 1), ("1x", 0), ("null", 1)]


@query(f"SELECT {K}, CASE WHEN {case(len(QUOTED), [str(x[1]) for x in QUOTED])} = '1' THEN '\"' || {case(len(QUOTED), [x[0] for x in QUOTED])} || '\"' ELSE {case(len(QUOTED), [x[0] for x in QUOTED])} END AS quoted FROM part")
def quoting(spark, sf_dir):
    return part(spark, sf_dir, value=case(len(QUOTED), [x[0] for x in QUOTED])).select(K, text.quoted(F.col("value")).alias("quoted"))


# Enrichment and points.

MADE = f"""SELECT {K}, f, 'p' || CAST({K} % 5 AS STRING) AS package_name, 'packages/p' || CAST({K} % 5 AS STRING) || '/src/m' || CAST({K} AS STRING) || '/' || CASE f WHEN 0 THEN 'Card.tsx' WHEN 1 THEN 'notes.md' WHEN 2 THEN 'a.types.ts' WHEN 3 THEN 'a.css' ELSE 'a.json' END AS rel_path,
CASE f WHEN 0 THEN '/** Shows one card of many */' || chr(10) || 'import "@x/p' || CAST(({K} + 1) % 5 AS STRING) || '"' || chr(10) || 'export const Card = ({{ title }}) => title' || chr(10) || 'const size = 3' || chr(10)
WHEN 1 THEN '# Data Grid' || chr(10) || 'The DataGrid of @x/p' || CAST({K} % 5 AS STRING) || ' shows rows, and this text is long enough to be a section of its own.' || chr(10) || '## Use' || chr(10) || 'Take the DataGrid and give it rows; it shows them, and this too is long enough to be one.' || chr(10)
WHEN 2 THEN 'export interface Props {{ title: string; a_long_name_that_makes_this_long_enough_to_stand_alone: number; another: string }}' || chr(10) WHEN 3 THEN '.card {{ color: red; border: 1px solid black; margin: 0 auto; padding: 1em 2em 3em 4em; width: 100% }}' || chr(10) ELSE '{{"a": 1}}' END AS content FROM"""
MADE_SQL = MADE + f" (SELECT {K}, unnest([0, 1, 2, 3, 4]) AS f FROM part)"
PREFIXES = {f"@x/p{i}": f"@x/p{i}" for i in range(5)}


def made_files(spark, sf_dir) -> DataFrame:
    spread(read(spark, sf_dir, "part")).select(K, F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("f")).createOrReplaceTempView("_made_points")
    out = spark.sql(MADE + " _made_points")
    path = F.col("rel_path")
    name = classify.base_name(path)
    out = out.withColumn("package_name", F.concat(F.lit("@x/"), "package_name")).withColumn("file_id", F.sha2("content", 256)).withColumn("module_path", F.lit(""))
    return out.withColumn("file_category", classify.package_category(path, name)).withColumn("language", classify.package_language(name))


@query(f"""WITH f AS ({MADE_SQL}) SELECT rel_path, 4::BIGINT AS related, CASE WHEN f = 0 THEN '@x/p' || (({K} + 1) % 5) ELSE '' END AS dependencies, CASE WHEN EXISTS (SELECT 1 FROM part p WHERE p.{K} % 5 = (f.{K} + 4) % 5) THEN '@x/p' || (({K} + 4) % 5) ELSE '' END AS used_by,
CASE WHEN f = 1 THEN 'DataGrid' ELSE '' END AS components, CASE f WHEN 0 THEN '@x/p' || (({K} + 1) % 5) WHEN 1 THEN '@x/p' || ({K} % 5) ELSE '' END AS packages FROM f""")
def enriched_files(spark, sf_dir):
    out = enrich.enriched(made_files(spark, sf_dir), PREFIXES)
    return out.select("rel_path", F.size("related_files").cast("long").alias("related"), joined("dependencies").alias("dependencies"), joined("used_by_packages").alias("used_by"), joined("mentioned_components").alias("components"), joined("mentioned_packages").alias("packages"))


@query(f"""WITH f AS ({MADE_SQL}), c AS (SELECT * FROM (VALUES (0, 0, 2, 'code', 'Card', 'function_component'), (0, 1, 2, 'code', 'size', 'utility'), (1, 0, 2, 'doc', 'Data Grid', 'section'), (1, 1, 2, 'doc', 'Use', 'section'), (2, 0, 1, 'config', 'Props', 'interface'), (3, 0, 1, 'code', '.card', 'style'), (4, 0, 1, 'config', 'a', 'interface')) t(g, i, n, content_type, name, kind))
SELECT rel_path AS file_path, i::BIGINT AS chunk_index, n::BIGINT AS total_chunks, content_type, name, CASE WHEN g = 0 AND i = 0 THEN 'Shows one card of many' WHEN content_type = 'doc' THEN 'section: ' || name WHEN g = 4 THEN 'json_config: a' ELSE kind || ': ' || name END AS summary FROM f JOIN c ON f = g""")
def unified_points(spark, sf_dir):
    p = enrich.unified_points(made_files(spark, sf_dir), PREFIXES, LAYERS)
    name = F.coalesce("symbol_name", "section_title", "schema_name")
    # the second chunk of a script has the imports in front, but not the comment before them
    return p.select("file_path", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "content_type", name.alias("name"), "summary")


@query(f"""SELECT {EXAMPLE_PATH} AS file_path, {FILE_NAME} AS file_name, CAST({K} AS VARCHAR) AS file_id, 'E' || CAST({K} % 50 AS VARCHAR) AS example_id, 'G' AS example_group, 0 AS chunk_index, 1 AS total_chunks, 'typescript' AS language,
{LOOSE_ROLE} AS file_role, sha256(trim({EXAMPLE}, chr(10) || ' ')) AS text_hash, CASE WHEN {K} % 10 = 0 THEN 'B' ELSE '' END AS demonstrated_symbols, CASE WHEN {K} % 10 = 0 THEN '@x/kit' ELSE '' END AS packages, true AS is_verified, 'x' AS related_files FROM part""")
def example_points(spark, sf_dir):
    rows = spread_part(spark, sf_dir, content=EXAMPLE, path=EXAMPLE_PATH, file_name=FILE_NAME, example_id=f"'E' || CAST({K} % 50 AS string)", example_group="'G'", file_id=f"CAST({K} AS string)", related_files="array('x')")
    p = enrich.example_points(rows, "@x/", "@x/kit")
    same = ("file_path", "file_name", "file_id", "example_id", "example_group", "chunk_index", "total_chunks", "language", "file_role", "text_hash", "is_verified")
    return p.select(*same, *[joined(c).alias(c) for c in ("demonstrated_symbols", "packages", "related_files")])
