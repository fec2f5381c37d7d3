"""What an example file shows: pattern, role, features, complexity and a line on its use. Two rule sets: by patterns, and loose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import chosen, ends, has

DASHBOARD, FORM = "ConfigurableDashboard", "ConfigurableForm"

# The patterns of features, the names of field types, the phrases of a line on the use.
PATTERN_SIGNS = {DASHBOARD: r"\b(?:ConfigurableDashboard|DashboardConfig|UserListConfig)\b", FORM: r"\b(?:ConfigurableForm|JSONFormSchema|FormConfig)\b"}
LOOSE_SIGNS = {DASHBOARD: ("ConfigurableDashboard", "DashboardConfig"), FORM: ("ConfigurableForm", "JSONFormSchema")}
DASHBOARD_FLAGS = {
    "has_search": r"(?i)hasSearch\s*:\s*true",
    "has_filters": r"\bfilters\s*[=:]\s*[\[{]",
    "has_actions": r"\bactions\s*[=:]\s*[\[{]",
    "has_list_view": r"\blistProps\b",
    "has_mode_switch": r"\b(?:enableModeSwitch|modeSwitchProps)\b",
    "has_pagination": r"\bpaginationParams\b",
    "has_advance_filters": r"\b(?:advanceFilterProps|advancedFilterProps)\b",
    "has_api_integration": r"(?i:\bapi\s*:)|\bapiResponseMapper\b",
    "has_row_selection": r"\browSelection\b",
}
FILTER_TYPES = {"select": r"""type\s*:\s*['"]select['"]""", "date-range": r"""type\s*:\s*['"]date[_-]?range['"]|startDateKey\b""", "text": r"""type\s*:\s*['"]text['"]""", "multiselect": r"""type\s*:\s*['"]multi[_-]?select['"]"""}
FORM_FLAGS = {
    "has_sections": r"\bsections\s*[=:]\s*[\[{]",
    "has_nested_groups": r"""type\s*:\s*['"]group['"]""",
    "has_custom_validators": r"\bcustomValidators\b",
    "has_custom_component": r"""type\s*:\s*['"]custom['"]""",
    "has_conditional_visibility": r"\bvisibleIf\b",
    "has_conditional_validation": r"\brequiredIf\b",
    "has_dependent_fields": r"\bdepends\s*[=:]\s*",
    "has_file_upload": r"""type\s*:\s*['"]fileUpload['"]""",
}
LOOSE_DASHBOARD_FLAGS = {
    "has_search": r"(?i)hasSearch\s*:\s*true",
    "has_filters": r"filters ?:",
    "has_actions": r"actions ?:",
    "has_list_view": r"listProps",
    "has_mode_switch": r"enableModeSwitch|modeSwitchProps",
    "has_pagination": r"paginationParams",
    "has_advance_filters": r"advanceFilterProps|advancedFilterProps",
    "has_api_integration": r"\bapi\s*:|apiResponseMapper",
    "has_row_selection": r"rowSelection",
}
LOOSE_FILTER_TYPES = {"select": r"""type\s*:\s*['"]select['"]""", "date_range": r"""type\s*:\s*['"]date[_-]?range['"]|startDateKey""", "text": r"""type\s*:\s*['"]text['"]"""}
LOOSE_FORM_FLAGS = {
    "has_sections": r"sections ?:",
    "has_nested_groups": r"""type\s*:\s*['"]group['"]""",
    "has_custom_validators": r"customValidators",
    "has_custom_component": r"""type\s*:\s*['"]custom['"]""",
    "has_conditional_visibility": r"visibleIf",
    "has_conditional_validation": r"requiredIf",
    "has_dependent_fields": r"depends ?:",
    "has_file_upload": r"""type\s*:\s*['"]fileUpload['"]""",
}
FIELD_TYPE = r"""type\s*:\s*['"](\w+)['"]"""
WIDE_FIELD_TYPE = r"""type\s*:\s*['"]([\w-]+)['"]"""
FIELD_TYPES = ("text", "email", "number", "date", "date-range", "select", "radio", "checkbox", "textarea", "password", "tel", "custom", "fileUpload", "file", "list", "map", "multiselect", "switch", "toggle", "datepicker", "autocomplete")
LOOSE_FIELD_TYPES = ("text", "email", "number", "date", "select", "radio", "checkbox", "textarea", "password", "tel", "custom", "fileUpload", "file", "multiselect", "switch", "toggle")
VALIDATORS = r"customValidators\s*=?\s*\{([^}]+)\}"
VALIDATOR_NAME = r"(\w+)\s*:"
PHRASES = {
    "has_search": "with search", "has_filters": "with filters", "has_advance_filters": "with advanced filter modal", "has_actions": "with bulk actions", "has_list_view": "with card/list view toggle",
    "has_mode_switch": "with table/grid mode switch", "has_pagination": "with pagination", "has_row_selection": "with row selection", "has_api_integration": "with API integration",
}
LOOSE_PHRASES = {
    "has_search": "with search", "has_filters": "with filters", "has_actions": "with bulk actions", "has_list_view": "with card/list view", "has_mode_switch": "with table/grid mode switch",
    "has_pagination": "with pagination", "has_advance_filters": "with advanced filter modal", "has_api_integration": "with API integration", "has_row_selection": "with row selection",
}
FORM_PHRASES = {
    "has_sections": "with sections", "has_nested_groups": "with nested group sections", "has_custom_validators": "with custom validators", "has_custom_component": "with custom rendered field",
    "has_conditional_visibility": "with conditional visibility (visibleIf)", "has_conditional_validation": "with conditional required (requiredIf)", "has_dependent_fields": "with dependent fields", "has_file_upload": "with file upload",
}
ROLE_WORDS = {"page_component": " page component: ", "config": " config: ", "types": " type definitions: "}
FLAGS = (*DASHBOARD_FLAGS, *FORM_FLAGS)
LISTS = ("filter_types", "field_types_used", "custom_validator_names")
#: Of complexity: (complex, medium) bounds, above which colons count; from which true flags count.
COLONS, LOOSE_COLONS = (20, 10), (15, 8)
POINTS, LOOSE_POINTS = (4, 2), (3, 1)


def pattern(source: Column, path: Column, loose: bool = False) -> Column:
    """The component that a file demonstrates: by its content, else by its path."""
    sign = (lambda p: has(source, *LOOSE_SIGNS[p])) if loose else (lambda p: source.rlike(PATTERN_SIGNS[p]))
    low = F.lower(path)
    return chosen([(sign(DASHBOARD), DASHBOARD), (sign(FORM), FORM), (has(low, "dashboard", "userlist"), DASHBOARD), (has(low, "form"), FORM)], "unknown")


def role(name: Column, source: Column, primitives: str, loose: bool = False) -> Column:
    """What a file is to its example. primitives: the package whose use without a main component makes a custom one."""
    low = F.lower(name)
    main = has(source, FORM, DASHBOARD) if loose else source.rlike(PATTERN_SIGNS[DASHBOARD]) | source.rlike(PATTERN_SIGNS[FORM])
    rules = [(has(low, "types"), "types"), (has(low, "config"), "config"), (has(source, primitives) & ~main, "custom_component"), (main, "page_component"), (ends(name, ".tsx", ".jsx"), "page_component")]
    return chosen(rules, "config" if loose else "unknown")


def among(names: Column, known: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_distinct(F.array_intersect(names, F.array(*[F.lit(x) for x in known]))))


def features(source: Column, shown: Column, loose: bool = False, narrow: bool = False) -> Column:
    """A struct of FLAGS and LISTS. Those of the other pattern than `shown` are false and empty.

    narrow: field types of letters only, so that "date-range" is never one."""
    dashboard, form = shown == DASHBOARD, shown == FORM
    first, second = (LOOSE_DASHBOARD_FLAGS, LOOSE_FORM_FLAGS) if loose else (DASHBOARD_FLAGS, FORM_FLAGS)
    flags = {k: dashboard & source.rlike(p) for k, p in first.items()} | {k: form & source.rlike(p) for k, p in second.items()}
    kinds = LOOSE_FILTER_TYPES if loose else FILTER_TYPES
    needs_filters = lambda k: not loose or k == "text"
    seen = [F.when(dashboard & source.rlike(p) & (flags["has_filters"] if needs_filters(k) else F.lit(True)), F.lit(k)) for k, p in kinds.items()]
    nothing = F.array().cast("array<string>")
    types = among(F.regexp_extract_all(source, F.lit(FIELD_TYPE if narrow or loose else WIDE_FIELD_TYPE), F.lit(1)), LOOSE_FIELD_TYPES if loose else FIELD_TYPES)
    names = F.regexp_extract_all(F.regexp_extract(source, VALIDATORS, 1), F.lit(VALIDATOR_NAME), F.lit(1))
    lists = (F.array_compact(F.array(*seen)), F.when(form, types).otherwise(nothing), F.when(flags["has_custom_validators"], names).otherwise(nothing))
    return F.struct(*[v.alias(k) for k, v in flags.items()], *[v.alias(k) for k, v in zip(LISTS, lists, strict=True)])


def graded(score: Column, bounds: tuple[int, int], above: bool) -> Column:
    over = (lambda b: score > b) if above else (lambda b: score >= b)
    return chosen([(over(bounds[0]), "complex"), (over(bounds[1]), "medium")], "simple")


def occurrences(source: Column, part: str) -> Column:
    return F.size(F.split(source, f"\\Q{part}\\E", -1)) - 1


def complexity(source: Column, file_role: Column, shown: Column, loose: bool = False) -> Column:
    """simple, medium or complex. shown: the struct of features."""
    flags = [k for k in FLAGS if not loose or k not in ("has_search", "has_api_integration", "has_row_selection")]
    points = sum((shown[k].cast("int") for k in flags), F.lit(0))
    types = graded(occurrences(source, ":"), LOOSE_COLONS if loose else COLONS, True)
    config = graded(points, LOOSE_POINTS if loose else POINTS, False)
    if loose:
        page = F.when(has(source, "useState") & (occurrences(source, "<") > 6), "medium").otherwise("simple")
        custom = F.lit("medium")
    else:
        many = (occurrences(source, "return (") > 1) | (occurrences(source, "<div") > 5)
        signs = has(source, "useState").cast("int") + has(source, "useEffect").cast("int") + many.cast("int")
        page = custom = F.when(signs >= 2, "medium").otherwise("simple")
    return F.when(file_role == "types", types).when(file_role == "config", config).when(file_role == "page_component", page).when(file_role == "custom_component", custom).otherwise(F.lit("simple"))


def use_case(example_id: Column, shown: Column, file_role: Column, f: Column, symbol: Column, loose: bool = False) -> Column:
    """A line on what an example shows: who it is, then phrases for the features that are true. f: the struct of features."""
    joined = lambda head, names, tail: F.concat(F.lit(head), names, F.lit(tail))
    filters = F.when(F.size(f["filter_types"]) > 0, joined("with ", F.array_join(f["filter_types"], "/"), " filters")).otherwise(F.lit("with filters"))
    validators = F.when(F.size(f["custom_validator_names"]) > 0, joined("with custom validators (", F.array_join(F.slice(f["custom_validator_names"], 1, 3), ", "), ")")).otherwise(F.lit("with custom validators"))
    special = {"has_filters": filters, "has_custom_validators": validators}
    phrase = lambda table: [F.when(f[k], special.get(k, F.lit(v))) for k, v in table.items()]
    fields = F.when(F.size(f["field_types_used"]) > 0, joined("with ", F.array_join(F.slice(f["field_types_used"], 1, 4), ", "), " fields"))
    listed = lambda head, parts: F.array_join(F.array_compact(F.array(F.lit(head), *parts)), ", ")
    body = F.when(shown == DASHBOARD, listed("Dashboard", phrase(LOOSE_PHRASES if loose else PHRASES))).when(shown == FORM, listed("Form", [fields, *phrase(FORM_PHRASES)])).otherwise(shown)
    words = F.lit(": ")
    for k, v in ROLE_WORDS.items():
        words = F.when(file_role == k, F.lit(v)).otherwise(words)
    words = F.when(file_role == "custom_component", joined(" custom component (", symbol, "): ")).otherwise(words)
    return F.concat(example_id, words, body)


def active(f: Column) -> Column:
    """The names of the flags that are true, in the order of FLAGS."""
    return F.array_compact(F.array(*[F.when(f[k], F.lit(k)) for k in FLAGS]))


def example_text(row: dict[str, Column]) -> Column:
    """The one chunk of an example file: lines on it, a rule, its source. row: example_id, group, name, role, pattern, complexity, use_case, features, symbols, exports, source."""
    first8 = lambda x: F.array_join(F.slice(x, 1, 8), ", ")
    flags = active(row["features"])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), row["example_id"], F.lit(" / "), row["role"], F.lit("] "), row["pattern"], F.lit(" example — "), row["group"]),
        F.concat(F.lit("File: "), row["name"], F.lit(" | Complexity: "), row["complexity"]),
        F.concat(F.lit("Use case: "), row["use_case"]),
        F.when(F.size(flags) > 0, F.concat(F.lit("Features: "), F.array_join(flags, ", "))),
        F.when(F.size(row["symbols"]) > 0, F.concat(F.lit("Imports: "), first8(row["symbols"]))),
        F.concat(F.lit("Exports: "), first8(row["exports"])),
        F.lit("---"),
        row["source"],
    )


def summary_text(example_id: Column, shown: Column, line: Column, f: Column, files: Column, grade: Column) -> Column:
    """A text on a whole example folder, without source."""
    bullets = F.array_join(F.transform(active(f), lambda x: F.concat(F.lit("  • "), F.replace(F.replace(x, F.lit("has_"), F.lit("")), F.lit("_"), F.lit(" ")))), "\n")
    some = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(names, ", ")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), example_id, F.lit("] Complete "), shown, F.lit(" example")),
        F.concat(F.lit("Use case: "), line),
        F.concat(F.lit("Complexity: "), grade),
        F.concat(F.lit("Files in this example: "), F.array_join(files, ", ")),
        F.when(bullets != "", F.concat(F.lit("Features:\n"), bullets)),
        some("Form field types: ", f["field_types_used"]),
        some("Filter types: ", f["filter_types"]),
    )
