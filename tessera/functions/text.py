"""Column functions on addresses, names, code text and profiles.  All run inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
CALL_TYPES = ("UNCONDITIONAL_CALL", "COMPUTED_CALL", "17", "19", "21")
GENERIC_NAME = r"\b(?:a\d+|arg\d+|arg_\d+|v\d+|var_[0-9A-Fa-f]+)\b"
DEFAULT_NAME = r"(?i)^(?:sub_|fun_|loc_)[0-9A-Fa-f]+$"
ENTRY_HINT = r"(?i)(?:^|_)(?:main|entry|start|w?main)(?:$|_)"
CONTROL_LINE = r"(?i)\b(?:if|else\s+if|switch|case|while|for)\b"
COMPARE = r"(==|!=|<=|>=|<|>|&&|\|\||\?)"
CODE_TOKEN = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^\s\p{L}\p{N}_]"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
NOT_CALLS = ("if", "for", "while", "switch", "return", "sizeof", "else")
# Categories in the order in which results name them, and their keywords.
ENVIRONMENT = {
    "anti_debug": ("isdebuggerpresent", "checkremotedebuggerpresent", "ntqueryinformationprocess", "beingdebugged", "debugport", "outputdebugstring"),
    "command_line": ("argv", "argc", "getcommandline", "commandlinetoargv", "lpcommandline"),
    "environment_var": ("getenv", "getenvironmentvariable", "setenvironmentvariable"),
    "file_system": ("createfile", "readfile", "writefile", "getfileattributes", "fopen(", "open(", "stat(", "access("),
    "network": ("socket(", "connect(", "send(", "recv(", "internetopen", "httpsendrequest", "winhttp", "wsastartup"),
    "privilege_process": ("openprocess", "createprocess", "createtoolhelp32snapshot", "gettokeninformation", "adjusttokenprivileges"),
    "registry": ("regopenkey", "regqueryvalue", "hkey_"),
    "timing": ("sleep(", "gettickcount", "queryperformancecounter", "timegettime", "rdtsc"),
    "vm_sandbox": ("vmware", "virtualbox", "vbox", "qemu", "sandbox", "hyper-v", "parallels"),
}


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def parse_hex(value: Column) -> Column:
    """Signed 64-bit address of hexadecimal text, with or without 0x; unsigned values over the
    signed range wrap; anything else, or more than 64 bits, is null."""
    digits = F.regexp_extract(F.trim(_blank(value)), r"^(?:0x)?([0-9A-Fa-f]+)$", 1)
    short = F.regexp_replace(digits, r"^0+(?=.)", "")
    return F.when((digits != "") & (F.length(short) <= 16), F.conv(short, 16, -10).cast("bigint"))


def parse_address(value: Column) -> Column:
    """Address given as 0x hexadecimal or as decimal text."""
    text = F.trim(value)
    return F.when(F.lower(text).startswith("0x"), parse_hex(F.lower(text))).when(text.rlike(r"^\d+$"), text.try_cast("bigint"))


def flag(value: Column) -> Column:
    """1, 0 or null of a loosely written truth value."""
    v = F.lower(F.trim(_blank(value)))
    return F.when(v.isin("true", "t", "1", "yes"), 1).when(v.isin("false", "f", "0", "no"), 0)


def symbol_kind(raw_type: Column, is_external: Column) -> Column:
    t = F.upper(F.trim(_blank(raw_type)))
    return (
        F.when(t.isin("FUNCTION", "FUNC"), F.when(F.coalesce(is_external, F.lit(0)) != 0, "import").otherwise("function"))
        .when(t == "LABEL", "label").when(t.isin("DATA", "OBJ", "OBJECT"), "data").otherwise("other"))


def format_address(va: Column) -> Column:
    return F.format_string("0x%08X", va)


def default_name(va: Column) -> Column:
    return F.format_string("sub_%08X", va)


def is_default_name(name: Column) -> Column:
    return name.rlike(DEFAULT_NAME)


def is_bare_hex(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike(r"^(0x)?[0-9a-f]{4,16}$")


def display_name(names: Column, va: Column) -> Column:
    """The least of the names, else the default one."""
    return F.coalesce(F.array_min(names), default_name(va))


def name_of_signature(signature: Column, fallback: Column | None = None) -> Column:
    """The token before the first parenthesis, without pointer signs."""
    name = F.regexp_replace(F.regexp_extract(_blank(signature), r"([^\s(]+)\s*\(", 1), r"^[*&]+|[*&]+$", "")
    return F.when(name != "", name).otherwise(fallback if fallback is not None else F.lit(""))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def effective_lines(code: Column) -> Column:
    """Lines that are neither blank nor a lone brace."""
    lines = F.filter(F.split(_blank(code), r"\r\n|\r|\n"), lambda x: ~F.regexp_replace(x, r"^\s+|\s+$", "").isin("", "{", "}"))
    return F.size(lines)


def generic_names(code: Column) -> Column:
    """Distinct default variable names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_blank(code), F.lit(GENERIC_NAME), F.lit(0))))


def environment_signals(text: Column) -> Column:
    """Categories of which any keyword occurs, in order."""
    def found(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(reduce(or_, [low.contains(k) for k in ks]), F.lit(c)) for c, ks in ENVIRONMENT.items()]))

    # the lower-cased text is made once for all keywords
    return F.get(F.transform(F.array(F.lower(_blank(text))), found), F.lit(0))


def code_tokens(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_blank(code), F.lit(CODE_TOKEN), F.lit(0)))


def callees_of(code: Column) -> Column:
    """Identifiers before a parenthesis that aren't keywords."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(_blank(code), F.lit(CALL), F.lit(1))), F.array(*map(F.lit, NOT_CALLS)))


def strings_of(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_blank(code), F.lit('"([^"]*)"'), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def name_tokens(value: Column, least: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Words of names: camel case and underscores split, lower case, short and stop words dropped."""
    words = F.regexp_extract_all(_blank(value), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.split(F.lower(F.regexp_replace(w, r"([a-z0-9])([A-Z])", "$1_$2")), "_")))
    kept = F.filter(F.array_distinct(parts), lambda w: F.length(w) >= least)
    return F.array_sort(F.array_except(kept, F.array(*map(F.lit, stop)).cast("array<string>")) if stop else kept)


def plain_tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-case word tokens of at least ``least`` characters."""
    found = F.transform(F.regexp_extract_all(_blank(text), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    return F.array_sort(F.filter(F.array_distinct(found), lambda w: F.length(w) >= least))


def board_tokens(text: Column) -> Column:
    """Keywords of a blackboard value."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(_blank(text)), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0))))


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def normal_address(text: Column) -> Column:
    """Lower-case hexadecimal form of an address; other text as it is."""
    va = parse_address(text)
    return F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(va))), text)


def is_subsequence(expected: Column, actual: Column) -> Column:
    """Whether ``expected`` occurs in ``actual`` in order, gaps allowed."""
    at = F.aggregate(actual, F.lit(0), lambda acc, x: acc + F.when(F.get(expected, acc).eqNullSafe(x) & (acc < F.size(expected)), 1).otherwise(0))
    return at == F.size(expected)


def rename_identifiers(code: Column, renames: Column) -> Column:
    """Word-bounded replacement of every key by its value, longest keys first, one after another;
    only identifiers count as values."""
    entries = F.filter(F.map_entries(renames), lambda e: (e["key"] != e["value"]) & e["value"].rlike(r"^[A-Za-z_]\w*$"))
    ordered = F.array_sort(entries, lambda a, b: F.when(F.length(a["key"]) > F.length(b["key"]), -1).when(F.length(a["key"]) < F.length(b["key"]), 1).when(a["key"] < b["key"], -1).otherwise(1))
    # \Q..\E keeps keys literal
    return F.aggregate(ordered, code, lambda acc, e: F.regexp_replace(acc, F.concat(F.lit(r"\b\Q"), e["key"], F.lit(r"\E\b")), e["value"]))


def clean_renames(renames: Column) -> Column:
    return F.map_filter(renames, lambda k, v: (k != v) & v.rlike(r"^[A-Za-z_]\w*$"))


def clean_comment(text: Column, limit: int = 200) -> Column:
    """A one-line comment without its marks; null if it is blank or looks like code."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.trim(_blank(text)), r"^/+\s*", ""), r"[\r\n]+", " "))
    code_like = (F.regexp_count(flat, F.lit(r"[{};()\[\]=<>]")) >= 6) & (F.length(flat) > 60)
    return F.when((flat != "") & ~code_like, F.substring(flat, 1, limit))


def comment_cap(lines: Column, most: int, ratio: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), (lines * ratio).cast("int")))


def with_comment(line: Column, comment: Column) -> Column:
    """A line with a comment behind it, joined to one that is there; blanks and braces stay."""
    bare = F.trim(line)
    joined = F.when(line.contains("//"), F.concat(F.rtrim(line), F.lit(" | "), comment)).otherwise(F.concat(F.rtrim(line), F.lit("  // "), comment))
    return F.when(comment.isNull() | bare.isin("", "{", "}"), line).otherwise(joined)


def is_annotated(body: Column) -> Column:
    """Three or more comment marks in the first 1500 characters."""
    return F.regexp_count(F.substring(_blank(body), 1, 1500), F.lit("//")) >= 3


def estimated_tokens(text: Column) -> Column:
    """Rough number of model tokens: words, CJK signs, punctuation, and a share of the rest."""
    t = _blank(text)
    words = F.regexp_count(t, F.lit("[A-Za-z0-9_]+"))
    word_chars = F.length(F.regexp_replace(t, "[^A-Za-z0-9_]", ""))
    cjk = F.regexp_count(t, F.lit(r"[一-鿿]"))
    punctuation = F.regexp_count(t, F.lit(r"(?![_])\p{P}"))
    rest = F.greatest(F.lit(0), F.length(t) - word_chars - cjk - punctuation - F.regexp_count(t, F.lit(r"\s")))
    return F.ceil(words / 0.75 + cjk / 0.5 + punctuation / 3.0 + rest * 0.3)


def repaired_json(text: Column) -> Column:
    """Trailing commas dropped and line ends flattened."""
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r",\s*([}\]])", "$1")


def without_reasoning(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def safe_stem(name: Column, most: int = 100) -> Column:
    stem = F.regexp_replace(F.regexp_replace(_blank(name), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.when(stem == "", "unnamed").otherwise(F.substring(stem, 1, most))


def sheet_title(name: Column) -> Column:
    return F.substring(F.regexp_replace(_blank(name), r"[:\\/?*\[\]]", "_"), 1, 31)


def argument_names(prototype: Column) -> Column:
    """The last identifier of each parameter between the outermost parentheses."""
    inside = F.regexp_extract(_blank(prototype), r"\((.*)\)", 1)
    last = F.transform(F.split(inside, ","), lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])*\s*$", 1))
    return F.array_sort(F.array_distinct(F.filter(last, lambda n: (n != "") & ~n.isin("void"))))


def variable_names(prototype: Column, body: Column) -> Column:
    """Parameter names and assigned names, distinct and sorted."""
    assigned = F.regexp_extract_all(_blank(body), F.lit(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(?:[+\-*/|&^]|<<|>>)?=(?!=)"), F.lit(1))
    names = F.array_union(argument_names(prototype), F.array_distinct(assigned))
    return F.array_sort(F.filter(names, lambda n: ~n.rlike(r"^(?:__|sub_|loc_)") & ~n.isin("if", "else", "for", "while", "return", "switch", "case", "int", "char", "void", "long", "short", "unsigned", "signed", "const", "struct")))


def is_write(ref_type: Column) -> Column:
    return F.upper(_blank(ref_type)).contains("WRITE") | F.upper(_blank(ref_type)).contains("STORE")


def type_variants(text: Column) -> Column:
    """Spellings of ``A or B`` types, arrays also as pointers."""
    parts = F.filter(F.transform(F.split(_blank(text), r"\s+or\s+"), lambda t: F.trim(t)), lambda t: t != "")
    pointers = F.filter(F.transform(parts, lambda t: F.when(t.rlike(r"\[\d*\]\s*$"), F.regexp_replace(t, r"\s*\[\d*\]\s*$", " *"))), lambda t: t.isNotNull())
    return F.array_distinct(F.concat(parts, pointers))


def redacted(values: Column) -> Column:
    """A map of names to texts with the values of sensitive names replaced."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike("api_?key|token|secret|password|authorization") & v.isNotNull(), F.lit("***")).otherwise(v))
