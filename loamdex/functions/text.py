"""Column functions over text: tokens, identifiers, mark-up, rules and digests."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamdex.functions.batches import TEXT_BYTES, cuts, lengths

#: Words that a query's tokens lose, unless nothing would be left.
STOP_WORDS = (
    "a an the this that these those there here it its i we you me my our your us they them their is are was were be "
    "been being am do does did doing done have has had having can could should would will shall may might must of to in "
    "on at by for from with without into onto about across over under and or not but if then than as so such via per "
    "what which who whom whose when where why how find finds locate locating search searching show shows tell tells give "
    "gives get gets list lists explain explaining describe describing please help need needs want wants use uses using "
    "used above below more most some any all each every file files document documents thing things stuff"
).split()
#: Frequent words of code and mark-up that tell nothing of a corpus.
VOCABULARY_NOISE = (
    "self none true false null return def class import from print str int float bool list dict set tuple value values "
    "key keys name names type types data item items args kwargs param params result results test tests example examples "
    "new old http https www com org net html span div href src id style"
).split()
#: Words that end like plurals and aren't.
SINGULAR = (
    "analysis axis basis bias bus canvas class css data dns focus gas https ies index ios is its less lens news os pass "
    "process series species status this thus tls ux yes"
).split()
#: Openings that frame a remembered sentence.
FRAMES = (
    "note that", "please note", "remember that", "just so you know", "for the record", "for reference", "heads up", "fyi", "reminder",
)


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def extract_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order, repeats included."""
    return extract_all(F.lower(text), "[a-z0-9]+")


def split_identifier(name: Column) -> Column:
    """Parts of an identifier: at changes from lower to upper case and at whatever isn't a letter or digit."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda x: x != "")


def query_tokens(query: Column, drop_stop_words: bool = True) -> Column:
    """Sorted distinct tokens of a query: ASCII words, and the parts of those with underscores or camel case.

    Stop-words are left out unless nothing else would remain.
    """
    raw = extract_all(query, "[A-Za-z][A-Za-z0-9_]{1,}")
    parts = F.flatten(F.transform(raw, split_identifier))
    tokens = F.array_distinct(F.transform(F.concat(raw, F.filter(parts, lambda x: F.length(x) > 1)), F.lower))
    if drop_stop_words:
        kept = F.array_except(tokens, words_array(STOP_WORDS))
        tokens = F.when(F.size(kept) > 0, kept).otherwise(tokens)
    return F.array_sort(tokens)


def graph_tokens(query: Column) -> Column:
    """Sorted distinct lower-cased words with digits and underscores, of two characters at least, and their parts."""
    raw = extract_all(F.lower(query), "[a-z0-9_]{2,}")
    parts = F.filter(F.flatten(F.transform(raw, lambda t: F.split(t, "_"))), lambda x: F.length(x) > 1)
    return F.array_sort(F.array_distinct(F.concat(raw, parts)))


def slug(value: Column) -> Column:
    """Lower case, with runs of other than letters and digits as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_term(value: Column) -> Column:
    """Slugs of the parts of an identifier, joined by blanks."""
    return F.array_join(F.filter(F.transform(split_identifier(value), slug), lambda x: x != ""), " ")


def singular(word: Column) -> Column:
    """The singular of a lower-case English word by rule: -ies, then -es after a hiss, then -s but not -ss; short and listed words stay."""
    cut = lambda n: word.substr(F.lit(1), F.length(word) - n)
    return (
        F.when(word.isin(*SINGULAR) | (F.length(word) < 4) | word.endswith("ss"), word)
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(s|x|z|ch|sh)es$"), cut(2))
        .when(word.endswith("s"), cut(1))
        .otherwise(word)
    )


def normalize_concept(value: Column) -> Column:
    """``normalize_term`` with every word in the singular."""
    return F.array_join(F.transform(F.split(normalize_term(value), " "), singular), " ")


def tidy(text: Column) -> Column:
    """White space in order: no carriage returns, single blanks within lines, two line ends in a row at most, trimmed."""
    steps = (("\r\n?", "\n"), ("[ \t\f]+", " "), (" ?\n ?", "\n"), ("\n{3,}", "\n\n"))
    return F.regexp_replace(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text), "^\\s+|\\s+$", "")


#: HTML's entities that are undone; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags as line ends, entities undone, then tidied."""
    bare = F.regexp_replace(html, "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", "\n")
    return tidy(reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, bare))


def html_outline(html: Column) -> Column:
    """``html_text`` with headings marked as in mark-down, so that a page's outline can be read from it."""
    marked = reduce(lambda t, n: F.regexp_replace(t, f"(?is)<h{n}\\b[^>]*>(.*?)</h{n}\\s*>", "\n" + "#" * n + " $1\n"), range(1, 7), html)
    return html_text(marked)


def html_title(html: Column) -> Column:
    return tidy(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    """Targets of a page's links, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"'#?]+)"), F.lit(1)))


# The patterns of the next function decide what is found, and so are given.
def markdown_links(text: Column) -> Column:
    """Targets of inline links, wiki links and bare URLs, trimmed, sorted, each once."""
    text = F.coalesce(text, F.lit(""))
    inline = F.regexp_extract_all(text, F.lit("\\[[^\\]]+\\]\\(([^)]+)\\)"), F.lit(1))
    wiki = F.regexp_extract_all(text, F.lit("\\[\\[([^\\]]+)\\]\\]"), F.lit(1))
    found = F.transform(F.concat(inline, wiki, extract_all(text, "https?://[^\\s)>\\]]+")), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


# The patterns of the next function decide what is found, and so are given.
def entities(text: Column) -> Column:
    """Camel-case names and runs of two to four capitalised words, sorted, each once; word edges are Unicode's."""
    camel = extract_all(text, "(?U)\\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\\b")
    titled = extract_all(text, "(?U)\\b[A-Z][a-z]+(?:[ \\t]+[A-Z][a-z]+){1,3}\\b")
    return F.array_sort(F.array_distinct(F.concat(camel, titled)))


#: Labels in brackets that cite nothing, and what version labels look like.
NO_CITATION = ("x", "ok", "tbd", "todo", "na", "n/a", "unreleased", "yes", "no", "y", "n")
VERSION = "^[vV]?[0-9xXyYzZ]+([._-][0-9xXyYzZ]+)*$"


# The patterns of the next function decide what is found, and so are given.
def citations(text: Column) -> Column:
    """Bracketed labels, in order, each once whatever its case, without short ones, marks and version numbers."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\[@?([A-Za-z0-9_.:-]+)\\]"), F.lit(1))
    good = F.filter(found, lambda c: (F.length(c) >= 3) & ~F.lower(c).isin(*NO_CITATION) & ~c.rlike(VERSION))
    low = F.transform(good, F.lower)
    return F.filter(good, lambda c, i: F.array_position(low, F.lower(c)) == i + 1)


# The patterns of the next function decide what is found, and so are given.
def strip_frontmatter(text: Column) -> Column:
    """The text without a block of YAML between lines of three hyphens at its very beginning."""
    return F.regexp_replace(text, "(?s)\\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(\r?\n|\\z)", "")


@F.arrow_udf(StringType())
def folded(text: pa.Array) -> pa.Array:
    """Compatible characters as one (NFKC), no case, single blanks: Spark has no function for the first two."""
    plain = lambda t: t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold()
    made = lambda part: pa.array([None if t is None else " ".join(plain(t).split()) for t in part.to_pylist()], pa.string())
    return pa.concat_arrays([pa.array([], pa.string()), *(made(text.slice(i, j - i)) for i, j in cuts(lengths(text), TEXT_BYTES))])


def normalized_sentence(text: Column) -> Column:
    """What two remembered sentences share if they say the same: folded, no closing marks, no opening frame, then no article."""
    framed = F.regexp_replace(F.regexp_replace(folded(text), "[.,;:!? ]+$", ""), "^(" + "|".join(FRAMES) + ")[ \t:,–—-]*", "")
    return F.trim(F.regexp_replace(framed, "^(the|an|a) ", ""))


def digest(*parts: Column) -> Column:
    """A digest of parts in order; null parts count as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def query_id(text: Column) -> Column:
    """The id of a question: its canonical text's digest, shortened."""
    return F.substring(F.sha2(F.lower(F.trim(F.regexp_replace(text, "\\s+", " "))), 256), 1, 16)


def safe_filename(raw: Column, fallback: str = "upload") -> Column:
    """A file name without folders, control marks or leading dots, of 120 characters at most."""
    base = F.element_at(F.split(F.regexp_replace(raw, "\\\\", "/"), "/"), -1)
    clean = F.substring(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), "^[._]+", ""), 1, 120)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(fallback)).otherwise(clean)


def traceparent(header: Column) -> Column:
    """(trace_id, span_id) of a W3C trace header; null if it isn't one or an id is all zeros."""
    pattern = "^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}$"
    trace, span = F.regexp_extract(header, pattern, 1), F.regexp_extract(header, pattern, 2)
    good = (trace != "") & ~trace.rlike("^0+$") & ~span.rlike("^0+$")
    return F.when(good, F.struct(trace.alias("trace_id"), span.alias("span_id")))


def redacted(text: Column, length: int = 200, marker: str = "…") -> Column:
    """Text cut to a length, with a marker where something is missing."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(marker))).otherwise(text)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` cross folders too."""
    marks = {"*": ".*", "?": "."}
    return "^" + "".join(marks.get(c, c if c.isalnum() or c in "_/-" else "\\" + c) for c in glob) + "$"


def matches_any(path: Column, globs) -> Column:
    """Whether a path, with or without a leading slash, matches one of the globs."""
    tests = [path.rlike(glob_pattern(g)) | F.concat(F.lit("/"), path).rlike(glob_pattern(g)) for g in globs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def artifact_type(path: Column) -> Column:
    """What a file is, by its extension."""
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    kinds = {
        "code": ("py", "js", "ts", "java", "go", "rs", "c", "cpp", "rb", "sh", "sql"),
        "document": ("md", "rst", "txt", "html", "htm", "pdf", "docx", "rtf", "epub"),
        "data": ("json", "yaml", "yml", "csv", "parquet", "toml", "xml"),
        "image": ("png", "jpg", "jpeg", "gif", "svg", "webp"),
        "audio": ("mp3", "wav", "m4a", "ogg"),
    }
    out = None
    for kind, exts in kinds.items():
        out = F.when(ext.isin(*exts), kind) if out is None else out.when(ext.isin(*exts), kind)
    return out.otherwise("other")


# The patterns of the next function decide what is found, and so are given.
def rule(kind: Column, text: Column) -> Column:
    """A steering rule (terms, values) read from its text; null if it doesn't follow its kind's grammar.

    ``alias``: term -> a, b. ``preference``: when: x, y -> prefer: path/. ``exclusion``: never: fragment.
    """
    items = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(F.lower(x))), lambda x: x != "")
    made = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.struct(a.alias("terms"), b.alias("values")))
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    alias, prefer, never = "^\\s*([^,>:]+?)\\s*->\\s*(.+)$", "(?i)^\\s*when:\\s*(.+?)\\s*->\\s*prefer:\\s*(\\S+)\\s*$", "(?i)^\\s*never:\\s*(\\S.*?)\\s*$"
    return (
        F.when(kind == "alias", made(items(part(alias, 1)), F.slice(items(part(alias, 2)), 1, 8)))
        .when(kind == "preference", made(items(part(prefer, 1)), items(part(prefer, 2))))
        .when(kind == "exclusion", made(F.array(F.lit("never")), items(part(never, 1))))
    )
