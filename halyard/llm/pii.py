"""Personal data: patterns, and information-theoretic sanitisation around them.

Patterns find the protected entities (e-mail, IPv4 address, payment card,
phone). The corpus then tells which other words give an entity away: with
documents as the sample space, the share of the entity's information that a
word reveals is

    PMI(word; entity) / IC(entity),   IC = log2(N / n_e),
    PMI = log2(n_te * N / (n_t * n_e))

n_te counts the documents that hold both, at whatever distance, n_t and n_e
those that hold either. A word that reveals at least `REVEAL` of it is
generalised wherever it stands in a document of the entity, one that reveals
`REMOVE` is removed. This holds for an entity of a single document too: what no
or hardly any other document says leads to it. A document without personal
data stays as it is.

Words can't reveal that much if n_t is over N^(1 - REVEAL) * n_e^REVEAL (n_te is
at most n_e), so those are left before words and entities are paired. What
stands in exactly the same documents has the same counts, so pairs are formed of
classes: all entities, and all words, of one set of documents (told by its size
and two 64-bit sums of row hashes) are one. A list of a thousand addresses that
only one document holds is one entity there.

All counts are aggregates over all documents; nothing is broadcast that isn't
small by Spark's own size check.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import numbered, python_ready, stored, with_row_id

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
REVEAL, REMOVE = 0.9, 0.98
#: What the sanitised text shows in place of a span; a removed word leaves nothing.
SHOWN = {k: f"[{k.upper()}]" for k in (*KINDS, TERM)}

# Fixed patterns. The guards only spare hopeless starts inside a run of digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = regex.compile(r"\p{L}+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every match has one `@`, so the search goes from one to the next: the
    local part is what stands before it, the domain what follows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind and start."""
    out = [("email", *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if len(m[0]) >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity_name(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def occurrences(text: str, spans: list[dict], words: dict[str, bool]) -> list[dict]:
    """Where `words` (word: removed) stand in the text outside the spans."""
    taken, out, k = [], [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    for m in _WORD.finditer(text):
        removed = words.get(m[0].lower())
        if removed is None:
            continue
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            out.append({"start": m.start(), "end": m.end(), "removed": removed})
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_TERMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("removed", pa.bool_())]))
_TERM_TYPE = "array<struct<start:long,end:long,removed:boolean>>"


def _scan(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`keep`, the spans, the different entities and, where there are any, the text."""

    def run(batches):
        for b in batches:
            texts, spans, entities = [], [], []
            for t in b.column(len(keep)).to_pylist():
                found = base_spans(t or "")
                texts.append(t if found else None)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                entities.append(sorted({entity_name(k, t[s:e]) for k, s, e in found}))
            columns = [pa.array(texts, pa.string()), pa.array(spans, _SPANS), pa.array(entities, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns], names=[*keep, "__text", "__base", "__entities"])

    source = python_ready(docs).select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{kinds}, `__text` string, `__base` array<struct<kind:string,start:long,end:long>>, `__entities` array<string>")


def _words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    lower = F.transform(F.split(text, r"[^\p{L}]+"), F.lower)
    return F.array_distinct(F.filter(lower, lambda w: w != ""))


def _document_sets(members: DataFrame, key: str, row: str) -> DataFrame:
    """(key, n, set): how many documents hold it, and which set of them that is."""
    sums = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(row)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("y"))
    return sums.select(key, "n", F.struct("n", "x", "y").alias("set"))


def revealing_words(holders: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(row, words): the (word, removed) that reveal at least REVEAL of an entity
    of the row. `holders` has (row, entities, text) of the documents of `docs`
    that hold one."""
    n = float(docs.count())
    named = holders.select("row", F.explode("entities").alias("entity"))
    entities = _document_sets(named, "entity", "row")
    classes = stored(named.join(entities, "entity").select("row", F.col("set").alias("e")).distinct())
    most = lambda n_e: F.lit(n ** (1 - REVEAL) * (1 + 1e-9)) * F.pow(n_e, F.lit(REVEAL))
    largest = float(classes.agg(F.max("e.n")).first()[0] or 0)

    rows = with_row_id(docs.select(F.col(text).cast("string").alias("text")), "at")
    used = _document_sets(rows.select("at", F.explode(_words(F.col("text"))).alias("word")), "word", "at")
    held = stored(holders.select("row", F.explode(_words(F.col("text"))).alias("word")))
    rare = stored(used.filter(F.col("n") <= most(F.lit(largest))).join(held.select("word").distinct(), "word", "left_semi"))
    known = stored(held.join(rare, "word").select("row", "word", F.col("set").alias("t")))

    met = known.select("row", "t").distinct().join(classes, "row").filter(F.col("t.n") <= most(F.col("e.n")))
    counted = met.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_te"))
    n_t, n_e = F.col("t.n"), F.col("e.n")
    pmi, ic = F.log2(F.col("n_te") * F.lit(n) / (n_t * n_e)), F.log2(F.lit(n) / n_e)
    shares = counted.withColumn("share", F.when(ic > 0, pmi / ic)).filter(F.col("share") >= REVEAL).select("e", "t", "share")
    told = met.join(shares, ["e", "t"]).groupBy("row", "t").agg((F.max("share") >= REMOVE).alias("removed"))
    return known.join(told, ["row", "t"]).groupBy("row").agg(F.collect_list(F.struct("word", "removed")).alias("words"))


def find_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per row of `docs`: the columns `keep`, `base` (pattern spans by
    kind and start) and `terms` (start, end, removed) of revealing words by
    start; offsets in code points, ends exclusive.

    A null text is an empty one; both have no spans. Repeated rows come back
    each, and count as a document each. Texts are read whole."""
    seen = stored(_scan(with_row_id(docs, "__row"), ["__row", *keep], text))
    holders = seen.filter(F.size("__base") > 0).select(F.col("__row").alias("row"), F.col("__entities").alias("entities"), F.col("__text").alias("text"), F.col("__base").alias("base"))
    words = revealing_words(holders, docs, text)

    @F.arrow_udf(_TERM_TYPE)
    def marked(t, b, w):
        rows = zip(t.to_pylist(), b.to_pylist(), w.to_pylist())
        return pa.array([occurrences(x, y, {v["word"]: v["removed"] for v in z}) for x, y, z in rows], _TERMS)

    by_row = holders.join(words, "row").select(F.col("row").alias("__row"), marked("text", "base", "words").alias("__terms"))
    joined = seen.select("__row", *keep, "__base").join(by_row, "__row", "left")
    return joined.select(*keep, F.col("__base").alias("base"), F.coalesce("__terms", F.array().cast(_TERM_TYPE)).alias("terms"))


def written(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counts(base: Column) -> dict[str, Column]:
    return {f"n_{k}": F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long") for k in KINDS}


def cleaned(text: str, base: list[dict], terms: list[dict]) -> str:
    """The text with its entities and revealing words generalised or removed.
    Of overlapping spans the one that starts first is shown, over all they cover."""
    marks = sorted([(s["start"], -s["end"], SHOWN[s["kind"]]) for s in base] + [(t["start"], -t["end"], "" if t["removed"] else SHOWN[TERM]) for t in terms])
    parts, at = [], 0
    for start, end, shown in marks:
        end = -end
        if start >= at:
            parts += [text[at:start], shown]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `text` sanitised; null texts stay null."""
    rows = numbered(docs, "__at")
    found = find_pii(rows, ["__at"], text).withColumnsRenamed({"__at": "__of", "base": "__base", "terms": "__terms"}).filter(F.size("__base") > 0)
    joined = rows.join(found, F.col("__at") == F.col("__of"), "left")

    @F.arrow_udf("string")
    def clean(t, b, x):
        rows = zip(t.to_pylist(), b.to_pylist(), x.to_pylist())
        return pa.array([None if v is None else cleaned(v, p or [], q or []) for v, p, q in rows], pa.string())

    return joined.select(*[clean(F.col(c).cast("string"), "__base", "__terms").alias(c) if c == text else F.col(c) for c in docs.columns])
