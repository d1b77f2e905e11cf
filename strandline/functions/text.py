"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` computed once, however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up: the default where no tokenizer is given."""
    return F.ceil(F.length(text) / 4).cast("long")


def within_tokens(text: Column, most: int) -> Column:
    """The start of a text that `estimated_tokens` puts at `most` tokens; the whole text where it has no more."""
    return F.when(estimated_tokens(text) <= most, text).otherwise(F.substring(text, 1, 4 * most))


#: Tokens that a message's form takes, and that the answer's beginning takes.
MESSAGE_TOKENS, ANSWER_TOKENS = 4, 2


def messages_tokens(messages: Column) -> Column:
    """Estimated tokens of an array of (role, content) with their forms; of no message those of the answer's beginning."""
    one = lambda m: F.lit(MESSAGE_TOKENS) + F.coalesce(estimated_tokens(m["role"]), F.lit(0)) + F.coalesce(estimated_tokens(m["content"]), F.lit(0))
    return F.aggregate(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")), F.lit(ANSWER_TOKENS).cast("long"), lambda n, m: n + one(m))


def state_hash(value: Column) -> Column:
    """A digest of a map that doesn't depend on the order of its keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value)))), 256)


def search_terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def counts(words: Column) -> Column:
    """Each word of an array with how often it is there (term, tf): runs of the sorted array, so that no row leaves its place."""

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, n: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(s)) - i).cast("int").alias("tf"))))

    return let(F.sort_array(words), of_sorted)


def word_count(text: Column) -> Column:
    """Runs of other characters than blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def redact(text: Column) -> Column:
    for pattern, mark in W.SECRETS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def without_images(text: Column, most: int = 4000) -> Column:
    return F.substring(F.regexp_replace(text, W.IMAGES, W.IMAGE_MARK), 1, most)


def without_artifacts(text: Column) -> Column:
    """Without fenced blocks and control tags, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"<\|[^|>]*\|>", ""))


def head_and_tail(text: Column, longest: int, head: int, tail: int, mark: str) -> Column:
    """Texts of over `longest` characters as their head and tail; `mark` is a format for what is between."""
    cut = F.concat(F.substring(text, 1, head), F.format_string(mark, F.length(text) - (head + tail)), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > longest, cut).otherwise(text)


def truncated(text: Column) -> Column:
    return head_and_tail(text, 10_240, 8_112, 2_028, "\n\n... [truncated: %d bytes omitted] ...\n\n")


def snippet(text: Column) -> Column:
    return head_and_tail(text, 2_048, 1_536, 512, "\n\n... [%d characters omitted] ...\n\n")


def slug(text: Column) -> Column:
    """Letters, digits, blanks, dashes and underscores of the first 40 characters."""
    return F.trim(F.regexp_replace(F.substring(text, 1, 40), r"[^\p{L}\p{N} _-]", ""))


def signature(text: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 12)


def event_hash(id_: Column, role: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", id_.cast("string"), role, text), 256), 1, 32)


def event_type(event: Column, text: Column) -> Column:
    start, end = text.startswith("[tool:start]"), text.startswith("[tool:end]")
    return (
        F.when(event == "tool.execute.before", "tool_start").when(event == "tool.execute.after", "tool_end").when(start, "tool_start").when(end, "tool_end").otherwise("message")
    )


def count_of(text: Column, part: Column) -> Column:
    """How often a part occurs, not counting overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def noise_name(name: Column) -> Column:
    """Stop words, names without a letter, names of one or two characters, and no name."""
    listed = F.lower(F.trim(name)).isin(*W.NOISE_WORDS)
    return name.isNull() | (name == "") | listed | ~name.rlike("[a-zA-Z一-鿿]") | (F.length(name) <= 2)


def bad_name(name: Column, own: tuple[str, ...] = ()) -> Column:
    """Names that an extraction must not give: meta words, parts of them, the product's `own` names, mostly digits, too short."""
    parts = any_of([F.lower(name).contains(p) for p in (*W.BAD_NAME_PARTS, *own)])
    digits = F.length(F.regexp_replace(name, "[^0-9]", "")) > F.lit(0.3) * F.length(name)
    return name.rlike(W.BAD_NAME) | parts | digits | (F.length(name) < 2)


def plan_message(text: Column) -> Column:
    """Execution plans and analyses, which hold no facts; JSON never counts as one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    keywords = reduce(lambda a, b: a + b, [F.lower(t).contains(k).cast("int") for k in W.PLAN_KEYWORDS])
    marks = reduce(lambda a, b: a + b, [t.contains(m).cast("int") for m in W.STRUCTURE])
    is_json = t.startswith("{") | t.startswith("[") & ~t.startswith("[analyze-mode]") | t.startswith("```json")
    long_plan = (F.length(t) >= 1200) & (keywords >= 2) & (marks >= 2) | (F.length(t) >= 600) & (keywords >= 3) & (marks >= 3)
    return (t != "") & ~is_json & (any_of([t.startswith(p) for p in W.PLAN_PREFIXES]) | long_plan)


def boilerplate(text: Column) -> Column:
    """Markup, numbers only, under 20 characters, or a table of over five lines."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    table = (F.size(lines) > 5) & F.forall(lines, lambda x: x.contains("|")) & (count_of(t, F.lit("|")) > 2 * F.size(lines))
    return (F.trim(t).startswith("<") & F.trim(t).endswith(">")) | t.rlike(r"^[\d\.,\s\-\+%]+$") | (F.length(t) < 20) | table


def hidden_message(role: Column, event: Column, text: Column) -> Column:
    """Injected system messages that no prompt repeats."""
    return (role == "system") & (F.coalesce(event.isin(*W.HIDDEN_EVENTS), F.lit(False)) | any_of([text.contains(m) for m in W.HIDDEN_MARKERS]))


def relation_of_verb(verb: Column) -> Column:
    known = W.VERBS | {r: r for r in W.CORE_RELATIONS}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(verb))), F.lit("depends_on"))


def status(value: Column) -> Column:
    out = None
    for other, ours in W.STATUSES.items():
        out = F.when(value == other, ours) if out is None else out.when(value == other, ours)
    return out.otherwise(value)


def http_status(error: Column) -> Column:
    code = F.regexp_extract(error, r"\b(?:LLM|API|HTTP)\s*(?:API\s*)?(\d{3})\b", 1)
    return F.when(code != "", code.cast("int"))


def failure_class(error: Column) -> Column:
    """pause for bad credentials or addresses, retry for what may pass, else fail."""
    code, low = http_status(error), F.lower(error)
    soft = any_of([low.contains(x) for x in W.PASSING_FAILURES])
    return F.when(code.isin(401, 403, 404), "pause").when(code.isin(429, 500, 502, 503, 529) | soft, "retry").otherwise("fail")


def glob_pattern(globs: list[str]) -> str:
    """A regular expression for any of several globs with * and ?."""
    escape = lambda g: "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in g)
    return "^(?:" + "|".join(escape(g) for g in globs) + ")$"


def query_words(text: str, least: int = 3, most: int = 3) -> list[str]:
    """The longest words of a query."""
    import re

    found = [w for w in re.findall(r"[a-zA-Z0-9_\-\.]+", text) if len(w) >= least]
    return sorted(found, key=len, reverse=True)[:most]


def asks_for_recent(query: Column) -> Column:
    """Whether a query has a word, or part of one, that asks for what is newest; null queries don't."""
    return F.coalesce(F.lower(query).rlike("|".join(W.RECENCY_WORDS)), F.lit(False))


def json_set(document: Column, key: str, value: Column) -> Column:
    """A JSON object with `key` set to a JSON value, after the keys that stay as they are; null becomes an object of that key alone.

    What is no JSON object is left as it is.
    """
    fields = F.from_json(F.coalesce(document, F.lit("{}")), "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: k != key)
    patched = F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(value))))
    return F.when(F.coalesce(F.trim(document), F.lit("{")).startswith("{") & fields.isNotNull(), patched).otherwise(document)


def split_query(text: str) -> list[str]:
    """Terms of a query: parted at blanks, dashes, slashes and between scripts; CJK runs stay whole."""
    import re

    return [t for t in re.findall(r"[一-鿿]+|[^\s\-_/一-鿿]+", text) if len(t) > 1]


def sub_queries(query: str) -> list[str]:
    """Focused queries of a question: its names, and its names with each topic."""
    import re

    if len(query or "") < 3:
        return [query] if query else []
    words = query.split()
    names = []
    for before, word in zip(["", *words], words, strict=False):
        plain = re.sub(r"\W", "", word)
        named = len(plain) > 1 and plain[0].isupper() and plain[1:].islower() and plain.lower() not in W.QUERY_STOPWORDS
        if named and not before.endswith((".", "?", "!")):
            names.append(plain)
    topics = [w for w in re.findall(r"\b[a-z]{4,}\b", query.lower()) if w not in W.QUERY_STOPWORDS][:5]
    if not names:
        return topics[:3] or [query]
    broad = set(W.BROAD_TOPICS) & set(topics)
    found = [q for n in names[:2] for q in [n, *[f"{n} {t}" for t in topics[:3]], *([f"{n} {W.BROAD_QUERY}"] if broad else [])]]
    return list({q.lower(): q for q in reversed(found)}.values())[::-1][:10]


def sub_queries_of(query: Column) -> Column:
    """`sub_queries` of each row's question, by Arrow batches."""
    return F.udf(lambda q: sub_queries(q or ""), "array<string>", useArrow=True)(query)
