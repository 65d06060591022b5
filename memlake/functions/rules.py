"""Rules over short strings and records: ids, paths, markers, lines, projects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of tool calls that must not be stored.
LEAKED_MARKERS = ["<parameter", "</parameter", "<invoke", "</invoke", "<function_calls", "</function_calls", "<function_results"]


def compact_id(text: Column) -> Column:
    """An id without its dashes."""
    return F.replace(text, F.lit("-"), F.lit(""))


def digest_id(*parts: Column) -> Column:
    """128 bits of hash, as hex, over parts that a zero character separates."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32)


def has_marker(text: Column, markers: list[str]) -> Column:
    """Whether any marker occurs, whatever its case."""
    low = F.lower(text)
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m.lower()))
    return out


def one_line(text: Column) -> Column:
    """White space as single spaces; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def is_doc_type(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[A-Za-z0-9][A-Za-z0-9 ._-]{0,39}\z"), F.lit(False))


def requirement_name(text: Column) -> Column:
    """Name of the project in a requirement line: lower case, hyphens for underscores; null without one."""
    return F.nullif(F.replace(F.lower(F.regexp_extract(text, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)), F.lit("_"), F.lit("-")), F.lit(""))


def diagram_label(text: Column) -> Column:
    """A label that can stand in a diagram: no line breaks, double quotes or square brackets."""
    return F.translate(text, '\n\r"[]', "  '()")


def project_folder(path: Column) -> Column:
    """A path as one folder name."""
    return F.regexp_replace(path, "[^A-Za-z0-9-]", "-")


CONTROLS = r"[\x00-\x1f\x7f]"


def shown(text: Column, most: int = 40) -> Column:
    """A free text that is safe to show: no control characters, back ticks or round brackets; 'unknown' if nothing is left."""
    clean = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROLS, ""), "`()", "'[]")
    clean = F.trim(F.regexp_replace(clean, r"\s+", " "))
    return F.when(clean == "", "unknown").otherwise(F.substring(clean, 1, most))


def quoted_path(path: Column) -> Column:
    """A path without control characters in double quotes; quotes within become single ones."""
    return F.concat(F.lit('"'), F.translate(F.regexp_replace(path, CONTROLS, ""), '"', "'"), F.lit('"'))


def capped(line: Column, most: int = 120) -> Column:
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def without_section(text: Column, begin: str, end: str) -> Column:
    """Text without what stands between the marks; a mark without its twin goes by itself."""
    inner = F.regexp_replace(text, rf"(?s){begin}.*?{end}\n?", "")
    return F.regexp_replace(inner, rf"{begin}\n?|{end}\n?", "")


# How tool chains name files that nothing imports.
TEST_MARKS = [".test.", ".spec."]
TEST_FOLDERS = ["__tests__", "__mocks__", "e2e", "cypress"]
ROUTE_NAMES = ["page", "layout", "route", "template", "loading", "error", "not-found", "default", "middleware", "instrumentation"]
SCRIPT_ENDS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def is_entry_file(path: Column) -> Column:
    """Whether a script is loaded by its name: tests, tool configuration, dot files, routes."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    first = F.element_at(F.split(name, r"\."), 1)
    script = F.lit(False)
    for end in SCRIPT_ENDS:
        script = script | name.endswith(end)

    def within(names: list[str]) -> Column:
        return F.arrays_overlap(folders, F.array(*map(F.lit, names)))

    marked = F.lit(False)
    for mark in [*TEST_MARKS, ".config."]:
        marked = marked | name.contains(mark)
    routed = first.isin(*ROUTE_NAMES) & within(["app", "pages", "src"])
    return marked | within(TEST_FOLDERS) | (name.startswith(".") & script) | routed | within(["pages", "api"])


def module_name(path: Column) -> Column:
    """Dotted name of a Python file; a package's is that of its folder."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.array_join(F.filter(F.split(plain, "/"), lambda p: p != ""), ".")


def imported_name(source: Column, is_package: Column, level: Column, module: Column) -> Column:
    """Absolute name of an import with ``level`` dots before ``module`` (may be empty) in the module ``source``."""
    parts = F.split(source, r"\.")
    drop = F.when(is_package, level - 1).otherwise(level)
    base = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - drop))
    found = F.array_join(F.filter(F.concat(base, F.split(module, r"\.")), lambda p: p != ""), ".")
    return F.when(level == 0, module).otherwise(found)


# ---- lines that are shown


def triple_core(subject: Column, relation: Column, obj: Column, negated: Column) -> Column:
    core = F.concat_ws(" ", F.coalesce(subject, F.lit("?")), F.coalesce(relation, F.lit("?")), F.coalesce(obj, F.lit("?")))
    return F.when(negated, F.concat(F.lit("not ("), core, F.lit(")"))).otherwise(core)


def rationale(core: Column, evidence: Column, most: int = 120) -> Column:
    """First evidence text, cut, unless the triple says it already; null then."""
    text = F.nullif(F.trim(F.substring(F.coalesce(evidence, F.lit("")), 1, most)), F.lit(""))
    return F.when(~F.contains(F.lower(core), F.lower(text)), text)


def belief_line(core: Column, confidence: Column, domain: Column, why: Column) -> Column:
    more = F.when(domain.isNotNull(), F.concat(F.lit(", domain: "), domain)).otherwise("")
    tail = F.when(why.isNotNull(), F.concat(F.lit(" — "), why)).otherwise("")
    return F.concat(F.lit("- "), core, F.format_string(" (confidence: %.2f", confidence), more, F.lit(")"), tail)


def event_line(created: Column, subject: Column, relation: Column, what: Column) -> Column:
    day = F.coalesce(F.date_format(created, "yyyy-MM-dd"), F.lit("?"))
    return F.concat(F.lit("- "), day, F.lit(": "), F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (subject, relation, what))))


def skill_line(name: Column, confidence: Column) -> Column:
    return F.concat(F.lit("- "), F.coalesce(name, F.lit("unnamed skill")), F.format_string(" (confidence: %.2f)", confidence))


def edge_line(src: Column, relation: Column, dst: Column, confidence: Column, since: Column, until: Column, reconstructed: Column) -> Column:
    """A valid edge with its confidence, an invalid one with its span; reconstructed days have a tilde."""

    def day(c: Column, rough: Column) -> Column:
        return F.concat(F.when(rough, "~").otherwise(""), F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("?")))

    core = F.concat_ws(" ", src, relation, dst)
    gone = F.concat(F.lit("- ✗ "), core, F.lit(" ("), day(since, reconstructed), F.lit(" → "), day(until, F.lit(False)), F.lit(")"))
    added = F.when(reconstructed, F.concat(F.lit(", since "), day(since, F.lit(True)))).otherwise("")
    return F.when(until.isNotNull(), gone).otherwise(F.concat(F.lit("- "), core, F.format_string(" (%.2f", confidence), added, F.lit(")")))


def reflection_text(kind: Column, subject: Column, relation: Column, obj: Column, n: Column) -> Column:
    """A sentence about a pattern, by its kind."""
    times = n.cast("string")
    recurring = F.concat(F.lit("Reflection: "), subject, F.lit(" appears repeatedly in recent memory activity ("), times, F.lit(" occurrences)."))
    event = F.concat(F.lit("Reflection: "), subject, F.lit(" repeatedly "), F.regexp_replace(relation, "^repeatedly_", ""), F.lit(" "), obj, F.lit(" ("), times, F.lit(" occurrences)."))
    skill = F.concat(F.lit("Reflection: "), subject, F.lit(" consistently demonstrates "), obj, F.lit(" ("), times, F.lit(" observations)."))
    other = F.concat(F.lit("Reflection: "), F.concat_ws(" ", subject, relation, obj), F.lit(" ("), times, F.lit(" supporting memories)."))
    return F.when(kind == "recurring_entity", recurring).when(kind == "repeated_event_type", event).when(kind == "skill_generalization", skill).otherwise(other)


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def git_place(remote: Column) -> Column:
    """'host/path' of a remote in lower case, from an address or the short form host:path; without scheme, user, port, query and the ending .git.

    A host of one letter is a drive, and what has neither form is a path. Null stays null.
    """

    def parts(text: Column) -> Column:
        """Host and path of one remote."""
        address = _let(F.regexp_replace(F.substr(text, F.instr(text, "://") + 3), "[?#].*$", ""), lambda a: F.array(F.regexp_replace(F.substring_index(F.substring_index(a, "/", 1), "@", -1), ":[0-9]*$", ""), F.regexp_extract(a, "/(.*)$", 1)))
        short = _let(F.regexp_replace(F.substring_index(text, ":", 1), "^[^@/]*@", ""), lambda h: F.when((F.instr(text, ":") > 0) & (F.length(h) > 1) & ~h.rlike(r"[/\\@]"), F.array(h, F.regexp_extract(text, ":(.*)$", 1))))
        return F.when(F.instr(text, "://") > 0, address).otherwise(F.coalesce(short, F.array(F.lit(""), text)))

    def joined(p: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(F.element_at(p, 2), "^/+|/+$", ""), "[.]git$", "")
        return F.lower(F.regexp_replace(F.concat(F.element_at(p, 1), F.lit("/"), path), "^/+|/+$", ""))

    return F.when(remote.isNotNull(), _let(_let(F.trim(remote), parts), joined))


def repo_id(root_commit: Column, remote: Column, path: Column) -> Column:
    """16 hex digits of a repository: by its first commit, else its remote's place, else its path."""
    return F.substring(F.sha2(F.coalesce(root_commit, git_place(remote), path), 256), 1, 16)
