"""Text functions: normalising, truncating, rendering, quoting, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .enums import trim_all

ELLIPSIS = "…"


def collapse(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate_text(c: Column, n: int) -> Column:
    """White space collapsed; beyond n characters the first n, right-trimmed, and an ellipsis."""
    one = collapse(c)
    return F.when(F.char_length(one) > n, F.concat(F.rtrim(F.substring(one, 1, n)), F.lit(ELLIPSIS))).otherwise(one)


def render_with_variants(canonical: Column, notes: Column, cap: int, note_chars: int = 0) -> Column:
    """Trimmed text, then up to ``cap`` notes that aren't blank, each on a line, cut at ``note_chars``
    characters (0: whole), then how many were left out."""
    trimmed = F.filter(F.transform(notes, trim_all), lambda x: F.char_length(x) > 0)
    shown = F.slice(trimmed, 1, cap) if cap else F.slice(trimmed, 1, 0)
    if note_chars:
        shown = F.transform(shown, lambda x: F.when(F.char_length(x) > note_chars, F.concat(F.substring(x, 1, note_chars), F.lit(" …[truncated]"))).otherwise(x))
    body = F.array_join(F.transform(shown, lambda x: F.concat(F.lit("\n— "), x)), "")
    left = F.size(trimmed) - F.size(shown)
    more = F.when(left > 0, F.concat(F.lit("\n— (+"), left.cast("string"), F.lit(" more folded raws not shown)"))).otherwise("")
    return F.concat(trim_all(canonical), F.coalesce(body, F.lit("")), F.coalesce(more, F.lit("")))


def normalize_key(c: Column) -> Column:
    """ASCII letters and digits in lower case, anything else as one space between."""
    lower = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def quote_form(c: Column) -> Column:
    """For finding quotes: straight quotes, white space runs as one space, lower case."""
    return F.lower(F.regexp_replace(F.translate(c, "‘’‚‛“”„‟", "''''\"\"\"\""), r"(?U)\s+", " "))


def quoted_spans(c: Column, least: int) -> Column:
    """Spans between double quotes of at least ``least`` characters."""
    return F.regexp_extract_all(quote_form(c), F.lit('"([^"]{%d,})"' % least), F.lit(1))


def evidence_ok(evidence: Column, strength: Column, body: Column, floors: dict[str, int], quote: int = 25) -> Column:
    """Byte floor by strength; High also needs a quoted span that the finding's text holds."""
    floor = F.when(strength == "High", floors["High"]).when(strength == "Medium", floors["Medium"]).otherwise(floors["Low"])
    long_enough = F.octet_length(trim_all(evidence)) >= floor
    text = quote_form(body)
    found = F.exists(quoted_spans(evidence, quote), lambda s: F.contains(text, s))
    return long_enough & (F.when(strength == "High", found).otherwise(F.lit(True)))


def field_update(current: Column, candidate: Column, most: int = 2000, shrink: float = 0.6, guarded: int = 160) -> Column:
    """Why a new field text is refused; null if it is taken."""
    new, old = F.char_length(trim_all(candidate)), F.char_length(trim_all(current))
    return F.when(new == 0, "blank").when(new > most, "too long").when((old >= guarded) & (new < F.floor(old * shrink)), "shrinks")


def parameter_list(c: Column) -> Column:
    """White space collapsed, no space around commas, one pair of outer parentheses removed."""
    one = F.regexp_replace(collapse(c), " *, *", ",")
    return F.trim(F.regexp_replace(one, r"^\((.*)\)$", "$1"))


def relative_path(c: Column) -> Column:
    return F.regexp_replace(trim_all(c), r"^(\./)+", "")


def anchor(c: Column) -> Column:
    """Heading anchor: lower case, ASCII letters and digits, spaces and hyphens as hyphens."""
    return F.regexp_replace(F.translate(F.lower(c), " ", "-"), "[^a-z0-9-]", "")


def sql_literal(c: Column, dialect: str = "sqlite") -> Column:
    text = F.replace(c, F.lit("'"), F.lit("''"))
    if dialect == "mysql":
        text = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def sql_identifier(name: str, dialect: str = "sqlite") -> str:
    q = "`" if dialect == "mysql" else '"'
    return q + name.replace(q, q + q) + q


def redact_url(c: Column) -> Column:
    """Without user and password; text that isn't a URL becomes a placeholder."""
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")).otherwise("<redacted>")


def dot_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def dot_identifier(c: Column) -> Column:
    """Lower-case ASCII letters and digits, all else one underscore, none at the ends."""
    name = F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_|_$", ""))
    return F.when(name == "", "cluster").otherwise(name)


def short_label(c: Column, most: int = 120) -> Column:
    """Lines joined by spaces, at most ``most`` characters."""
    label = F.regexp_replace(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n", " ")
    return F.when(F.char_length(label) <= most, label).otherwise(F.concat(F.substring(label, 1, most - 3), F.lit("...")))


def setup_failed(status: Column, test: Column, reason: Column) -> Column:
    """A failure of the set-up, by the test's name or by its reason in any ASCII case."""
    told = F.contains(F.translate(F.coalesce(reason, F.lit("")), "ADEFILOPSTU", "adefilopstu"), F.lit("failed to set up"))
    return F.coalesce((status == "Failure") & ((test == "setUp()") | told), F.lit(False))


def wrap_label(c: Column, width: int) -> Column:
    """Greedy word wrap by byte width; blank text stays as it is."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: F.char_length(w) > 0)
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def step(s: Column, w: Column) -> Column:
        fits = (s["line"] == "") | (F.octet_length(s["line"]) + 1 + F.octet_length(w) <= width)
        line = F.when(s["line"] == "", w).when(fits, F.concat(s["line"], F.lit(" "), w)).otherwise(w)
        done = F.when(fits, s["done"]).otherwise(F.concat(s["done"], s["line"], F.lit("\n")))
        return F.struct(done.alias("done"), line.alias("line"))

    wrapped = F.aggregate(words, start, step, lambda s: F.concat(s["done"], s["line"]))
    return F.when(F.size(words) == 0, c).otherwise(wrapped)


def line_column(text: Column, offset: Column) -> Column:
    """Line (from 1) and column (from 0, in characters) of a byte offset.  An offset past the end or
    within a character raises."""
    before = F.substring(text.cast("binary"), F.lit(1), offset).cast("string")
    line = F.size(F.split(before, "\n"))
    last = F.element_at(F.split(before, "\n"), -1)
    place = F.struct(line.alias("line"), F.char_length(last).alias("column"))
    wrong = (offset > F.octet_length(text)) | ~F.is_valid_utf8(before)
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a place in the text: byte "), offset.cast("string")))).otherwise(place)


def _first_whole(cuts: list[Column]) -> Column:
    """The first of the cuts that splits no character."""
    return F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts])


def head_bytes(c: Column, n: int) -> Column:
    """At most n bytes from the front, cut between characters, with a note of what was dropped."""
    size = F.octet_length(c)
    kept = _first_whole([F.substring(c.cast("binary"), 1, k).cast("string") for k in range(n, max(n - 4, -1), -1)])
    return F.when(size <= n, c).otherwise(F.concat(kept, F.lit(" … ["), (size - F.octet_length(kept)).cast("string"), F.lit(" bytes truncated]")))


def tail_bytes(c: Column, n: int, note: bool = True) -> Column:
    """At most n bytes from the end, cut between characters; the note counts the bytes before the last n."""
    size = F.octet_length(c)
    kept = _first_whole([F.substring(c.cast("binary"), size - k + 1, F.lit(k)).cast("string") for k in range(n, max(n - 4, -1), -1)])
    told = F.concat(F.lit("…["), (size - n).cast("string"), F.lit(" bytes earlier]\n"), kept) if note else kept
    return F.when(size <= n, c).otherwise(told)


def invariant_stats(kind: Column) -> Column:
    """runs, calls and reverts of a test's kind, 0 where absent; null unless it is an invariant whose
    fields are whole numbers."""
    own = F.try_variant_get(F.try_parse_json(kind), "$.Invariant", "variant")
    names = ["runs", "calls", "reverts"]
    found = {n: F.try_variant_get(own, f"$.{n}", "variant") for n in names}
    whole = F.schema_of_variant(own).startswith("OBJECT")
    for f in found.values():
        whole = whole & (f.isNull() | (F.schema_of_variant(f) == "BIGINT"))
    return F.when(whole, F.struct(*[F.coalesce(F.try_variant_get(own, f"$.{n}", "long"), F.lit(0)).alias(n) for n in names]))


def whole_word(c: Column, word: str) -> Column:
    return c.rlike(r"\b" + word + r"\b")


def is_commit(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{40}$")


def snapshot_key(c: Column) -> Column:
    """The date and time digits that end a snapshot's name, else the whole name."""
    m = F.regexp_extract(c, r"_([0-9]{8}_[0-9]{6})$", 1)
    return F.when(m != "", m).otherwise(c)


def remapping(c: Column) -> Column:
    """``context:prefix=path`` as a struct; null where there is no prefix or path."""
    got = [F.regexp_extract(F.trim(c), r"^(?:([^:=]*):)?([^=:]+)=(.+)$", k) for k in (1, 2, 3)]
    return F.when(got[1] != "", F.struct(got[0].alias("context"), got[1].alias("prefix"), got[2].alias("path")))


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression over the whole path: ``**`` crosses folders."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("^(?:" + "|".join(map(glob_regex, globs)) + ")$") if globs else F.lit(False)


# Folders that hold no audited source.
_VENDORED = ("node_modules", "lib", "build", "artifacts", "cache", "test", "mock", "deploy", "script", "src/vendor")
NOT_AUDITED = ("test", "tests", "mock", "mocks", "script", "scripts", "deploy", "out", "artifacts", "cache", "broadcast", "node_modules", "target")


def vendored_globs(include_lib: bool = False) -> list[str]:
    folders = [f for f in _VENDORED if not (include_lib and f == "lib")]
    return [g for f in folders for g in (f, f"{f}/**", f"**/{f}", f"**/{f}/**")] + [".git/**", "target/**"]


def is_vendored(path: Column, include_lib: bool = False) -> Column:
    return matches_any(path, vendored_globs(include_lib))


def is_not_audited(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, NOT_AUDITED)))


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)/\*.*?\*/|//[^\n]*", " ")


def function_signature(source: Column) -> Column:
    """A function's text up to its body, without comments, white space collapsed."""
    return collapse(F.regexp_extract(without_comments(source), r"(?s)^([^{;]*)", 1))


def source_header(source: Column) -> Column:
    """What stands before the first contract, interface or library."""
    head = F.regexp_extract(source, r"(?sm)\A(.*?)^\s*(?:abstract\s+)?(?:contract|interface|library)\s+\w", 1)
    found = source.rlike(r"(?m)^\s*(?:abstract\s+)?(?:contract|interface|library)\s+\w")
    return F.when(found, head).otherwise(source)


def move_package(toml: Column) -> Column:
    """The name in the section of the package; null if there is none."""
    name = F.regexp_extract(toml, r'(?ms)^\s*\[package\][^\[]*?^\s*name\s*=\s*"([^"]*)"', 1)
    return F.when(name != "", name)


def is_deterministic_violation(reason: Column, marker: str, test: Column, set_up_failed: Column) -> Column:
    """The reason holds the marker that the harness's author was told to use, in a test that isn't a failed set-up."""
    return F.coalesce(F.contains(reason, F.lit(marker)) & test.startswith("test") & ~set_up_failed, F.lit(False))


def first_children(names: Column, n: int) -> Column:
    """The first n entries, one a line, and how many more there are."""
    more = F.size(names) - n
    body = F.array_join(F.transform(F.slice(names, 1, n), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(more > 0, F.concat(body, F.lit("\n- +"), more.cast("string"), F.lit(" more"))).otherwise(body)
