"""Secret scans that weigh each candidate by who holds it, over the whole corpus.

Patterns find candidates. Which of them are live is told by ownership: a value
in the files of one owner, or two, that looks random is a credential of that
owner; one that `WIDE_OWNERS` owners or more hold has been copied from a manual
or a tutorial. So the hashes of all candidates are aggregated over the corpus
to distinct repositories and owners, and the verdict goes back to every place
where the value stands, also where no keyword or fixed form names it.

A value that a third of all documents hold is one row per map task, repository
and owner before anything is shuffled.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import python_ready, stored, with_row_id

KINDS = ("assign", "access", "hex")
#: Kind of the spans that the method adds.
LIVE = "live"
#: From so many owners on, a value is widely copied.
WIDE_OWNERS = 3
#: A value looks live if it has so many different characters, a digit and none of these words.
LIVE_CHARACTERS = 8
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "your")

# Fixed patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Unnamed candidates: long runs with a digit and letters of either case.
_LOOSE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_DIGIT, _LOWER, _UPPER = re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"[A-Z]")


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the leftmost
    non-overlapping matches of each kind, by start, then kind as listed."""
    out = [("assign", *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        out += [(kind, *m.span(), *m.span()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def loose_spans(text: str, base: list[tuple]) -> list[tuple[int, int]]:
    """Unnamed candidates outside all base spans."""
    taken, k, out = base, 0, []
    reach = 0  # the furthest end of the base spans that start before this run's end
    for m in _LOOSE.finditer(text):
        while k < len(taken) and taken[k][1] < m.end():
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= m.start() and all(p.search(m[0]) for p in (_DIGIT, _LOWER, _UPPER)):
            out.append(m.span())
    return out


def looks_live(value: str) -> bool:
    low = value.lower()
    return len(set(value)) >= LIVE_CHARACTERS and bool(_DIGIT.search(value)) and not any(w in low for w in PLACEHOLDERS)


def _hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SEEN = pa.list_(pa.struct([("hash", pa.binary()), ("live", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`keep`, the base spans and the candidates of every text."""

    def run(batches):
        for b in batches:
            spans, seen = [], []
            for t in b.column(len(keep)).to_pylist():
                base = base_spans(t or "")
                places = sorted({(s[3], s[4]) for s in base} | set(loose_spans(t or "", base)))
                spans.append([{"kind": s[0], "start": s[1], "end": s[2]} for s in base])
                seen.append([{"hash": _hash(v), "live": looks_live(v), "start": x, "end": y} for x, y in places for v in (t[x:y],)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(spans, _BASE), pa.array(seen, _SEEN)], names=[*keep, "__base", "__seen"])

    source = python_ready(docs).select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{kinds}, `__base` array<struct<kind:string,start:long,end:long>>, `__seen` array<struct<hash:binary,live:boolean,start:long,end:long>>")


def ownership(seen: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) of `seen` (hash, repository, owner).
    A null name is a name of its own. Each step is a partial aggregate, so a
    value that is everywhere is no hot key."""
    by_repository = seen.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def owner_of(repository: Column) -> Column:
    """The part of a repository's name before the first `/`."""
    return F.split_part(repository, F.lit("/"), F.lit(1))


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text", repository: str = "source", owner: Column | None = None, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, `base` (kind, start, end;
    by start, then kind), `live` (start, end of owner-specific values that look
    live, by start) and `n_copied` (candidates that `wide_owners` owners or
    more hold). Offsets are code points, ends exclusive.

    `owner` defaults to the part of the repository's name before `/`. A null
    repository is one of its own name. A null text is an empty one; both have
    no spans. Repeated rows come back each and count as one holder. Texts are
    read whole. Kept columns called `base`, `live` or `n_copied` give way to
    the result's. No rows: none."""
    keep = [c for c in keep if c not in ("base", "live", "n_copied")]
    named = docs.select(
        *[F.col(c) for c in keep], F.col(text).cast("string").alias("__of"), F.col(repository).cast("string").alias("__repository"), (owner_of(F.col(repository).cast("string")) if owner is None else owner).alias("__owner")
    )
    # the row number is written with the rows, so every later use reads the same one
    seen = stored(_scan(with_row_id(named, "__row"), ["__row", "__repository", "__owner", *keep], "__of"))
    places = seen.select("__row", F.col("__repository").alias("repository"), F.col("__owner").alias("owner"), F.explode("__seen").alias("x")).select("__row", "repository", "owner", "x.*")
    owners = ownership(places.select("hash", "repository", "owner"))
    judged = places.join(owners, "hash").select(
        "__row", "start", "end", (F.col("n_owners") >= wide_owners).alias("copied"), ((F.col("n_owners") < wide_owners) & F.col("live")).alias("live")
    )
    place = F.when(F.col("live"), F.struct("start", "end"))
    by_row = judged.groupBy("__row").agg(F.array_sort(F.collect_list(place)).alias("__live"), F.count_if("copied").alias("__copied"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    joined = seen.join(by_row, "__row", "left")
    return joined.select(*keep, F.col("__base").alias("base"), F.coalesce("__live", none).alias("live"), F.coalesce("__copied", F.lit(0)).cast("long").alias("n_copied"))


def written(base: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_written(base: Column, live: Column) -> Column:
    """Base and added spans by start, then kind as listed, the added kind last."""
    number = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    every = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), number(s).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))),
        F.transform(live, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS) + 1).alias("k"), s["end"].alias("end"), F.lit(LIVE).alias("kind"))),
    )
    return written(F.array_sort(every))


def counts(base: Column) -> dict[str, Column]:
    return {f"n_{k}": F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long") for k in KINDS}


def redacted(text: str, live: list) -> str:
    """The text with its live values masked; overlapping ones are one mask."""
    parts, at = [], 0
    for s in live:
        if s["start"] >= at:
            parts += [text[at : s["start"]], "[SECRET]"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text", repository: str = "source", owner: Column | None = None) -> DataFrame:
    """`docs` with owner-specific values masked; widely copied examples and
    null texts stay as they are. The columns of `docs`, whatever their names."""
    at = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    owned = owner_of(F.col(repository).cast("string")) if owner is None else owner
    inner = docs.select(*[F.col(c).alias(n) for c, n in at.items()], owned.alias("__owned"))
    found = find_secrets(inner, list(at.values()), at[text], at[repository], F.col("__owned"))

    @F.arrow_udf("string")
    def mask(texts, live):
        return pa.array([None if t is None else redacted(t, x) for t, x in zip(texts.to_pylist(), live.to_pylist())], pa.string())

    return found.select(*[(mask(F.col(at[c]).cast("string"), "live") if c == text else F.col(at[c])).alias(c) for c in docs.columns])
