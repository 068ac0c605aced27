"""Benchmark decontamination under edit distance.

A document is contaminated by an item if some stretch of its words is within
`1 - similarity` times the item's words of edit distance from it (words are
`\\w+` in lower case, edits replace, insert or drop one word).

1. Windows: an occurrence with k edits keeps a run of at least
   (n - k) / (k + 1) of the item's n words, and at least n - q + 1 - k * q of
   its q-grams. Item-sized windows are laid where a document shares that many
   q-grams with an item of the size, lined up with each shared q-gram. Neither
   condition can lose an occurrence.
2. CGK embedding: windows and items of one size go through the same random
   walks, which turn few edits into few differing positions.
3. Bit sampling: each repetition hashes a few sampled positions of one walk; a
   window meets the items that agree in a repetition. For each item size,
   repetitions are added until simulated occurrences at the distance limit are
   met with the target recall; a size that doesn't reach it with
   `MAX_REPETITIONS` has all windows of step 1 verified.
4. Verification: exact edit distance of the item to the best stretch around
   the window.

The benchmark is the query set: it goes to all tasks in blocks of at most
about `BLOCK_ITEMS` items, and each block reads all documents once. Nothing of
the corpus is shuffled, so hot sources or common passages gather nowhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import numbered, python_ready, stored

SIMILARITY = 0.8
RECALL = 0.99
BLOCK_ITEMS = 20_000
WALKS = 4
SAMPLED = 2
MAX_REPETITIONS = 256
SIMULATED = 200
SEED = 11
MAX_GRAM = 3
WORD = re.compile(r"\w+")
#: A word pair or triple is told apart by 64 bits; equal ones of different words are only verified in vain.
GRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Walked positions a word, as in the embedding's definition.
STRETCH = 3


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edit_limit(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def best_stretch(item: np.ndarray, around: np.ndarray) -> tuple[int, int, int]:
    """(distance, begin, end): the stretch of `around` with the least edit
    distance to `item`; the shortest, then earliest of equals."""
    m = len(around)
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for c in item.tolist():
        swap = cost[:-1] + (around != c)
        new, begin = np.empty_like(cost), np.empty_like(origin)
        new[0], begin[0] = cost[0] + 1, origin[0]
        down = cost[1:] + 1
        take = np.where(swap <= down, swap, down)
        source = np.where(swap <= down, origin[:-1], origin[1:])
        left, from_left = int(new[0]), int(begin[0])
        for j, (v, o) in enumerate(zip(take.tolist(), source.tolist()), 1):
            if left + 1 < v:
                v, o = left + 1, from_left
            new[j], begin[j] = v, o
            left, from_left = v, o
        cost, origin = new, begin
    end = min(range(m + 1), key=lambda j: (cost[j], j - origin[j], j))
    return int(cost[end]), int(origin[end]), end


@dataclass
class Index:
    """What every task needs of one block of items: bounded by the block."""

    similarity: float
    vocabulary: dict[str, int] = field(default_factory=dict)
    items: dict[int, np.ndarray] = field(default_factory=dict)  # by position in the block
    names: list = field(default_factory=list)
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    shared: dict[int, int] = field(default_factory=dict)
    salts: np.ndarray | None = None
    samples: np.ndarray | None = None  # (repetition, SAMPLED) shares of the walk
    tables: dict[tuple[int, int], dict[int, list[int]]] = field(default_factory=dict)
    repetitions: dict[int, int] = field(default_factory=dict)  # by size; 0: all windows are verified
    recalls: dict[int, float] = field(default_factory=dict)  # simulated, by size


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def walk(rows: np.ndarray, salt: int) -> np.ndarray:
    """CGK embedding of (string, position) rows: step j writes the symbol under
    the pointer (0 past the end), then a random bit of (j, symbol) moves it on."""
    count, n = rows.shape
    padded = np.concatenate((rows, np.zeros((count, 1), rows.dtype)), axis=1)
    at, every = np.zeros(count, np.int64), np.arange(count)
    out = np.empty((count, STRETCH * n), np.int64)
    for j in range(STRETCH * n):
        symbol = padded[every, at]
        out[:, j] = symbol
        key = np.uint64(((salt << 10) + j) * 0x9E3779B97F4A7C15 % (1 << 64))
        step = _mix((symbol.astype(np.uint64) << np.uint64(20)) ^ key) & np.uint64(1)
        at = np.minimum(at + step.astype(np.int64), n)
    return out


def _codes(index: Index, rows: np.ndarray, repetitions: int) -> np.ndarray:
    """(repetition, string) hashes of the sampled positions."""
    walks = [walk(rows, int(s)) for s in index.salts]
    out = np.empty((repetitions, len(rows)), np.uint64)
    for r in range(repetitions):
        own = walks[r % WALKS]
        at = (index.samples[r] * own.shape[1]).astype(np.int64)
        code = np.zeros(len(rows), np.uint64)
        for p in at:
            code = _mix(code * np.uint64(31) + own[:, p].astype(np.uint64) + np.uint64(1))
        out[r] = code
    return out


def gram_keys(ids: np.ndarray, q: int) -> np.ndarray:
    """64-bit keys of all runs of q ids."""
    key = np.zeros(max(0, len(ids) - q + 1), np.uint64)
    for j in range(q):
        key = _mix(key * GRAM_FACTOR + ids[j : len(key) + j].astype(np.uint64))
    return key.view(np.int64)


def _simulated(index: Index, own: list[int], rng: np.random.Generator) -> np.ndarray:
    """(case, repetition): whether items of one size meet their copies with as
    many random edits as the limit allows, cut or filled to the size as a
    window is. There are SIMULATED cases, with few items several for each."""
    size, rows, n = len(index.vocabulary) + 1000, [], len(index.items[own[0]])
    for k in np.resize(rng.permutation(own), SIMULATED).tolist():
        item = index.items[k]
        copy = item.tolist()
        for _ in range(edit_limit(n, index.similarity)):
            at, kind = int(rng.integers(0, max(1, len(copy)))), int(rng.integers(0, 3))
            if kind == 0 and copy:
                copy[at] = int(rng.integers(1, size))
            elif kind == 1:
                copy.insert(at, int(rng.integers(1, size)))
            elif copy:
                del copy[at]
        rows += [item.tolist(), (copy + rng.integers(1, size, n).tolist())[:n]]
    codes = _codes(index, np.array(rows, np.int64), MAX_REPETITIONS)
    return (codes[:, ::2] == codes[:, 1::2]).T


def build_index(names: list, texts: list[str], similarity: float = SIMILARITY, recall: float = RECALL) -> Index:
    """Items without a word are left out: they match nothing."""
    index = Index(similarity, names=names)
    for k, text in enumerate(texts):
        found = words_of(text)
        if found:
            index.items[k] = np.array([index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in found], np.int64)
    by_gram: dict[int, list[tuple[int, int, int]]] = {}
    for k, item in index.items.items():
        n = len(item)
        limit = edit_limit(n, similarity)
        q = max(1, min(MAX_GRAM, -(-(n - limit) // (limit + 1))))
        index.shared[k] = max(1, n - q + 1 - limit * q)
        by_gram.setdefault(q, []).extend((key, k, p) for p, key in enumerate(gram_keys(item, q).tolist()))
    for q, rows in by_gram.items():
        rows.sort()
        table = np.array(rows, np.int64)
        keys, first, count = np.unique(table[:, 0], return_index=True, return_counts=True)
        index.grams[q] = (keys, first, count, table[:, 1:])
    rng = np.random.default_rng(SEED)
    index.salts = rng.integers(1, 1 << 20, WALKS)
    index.samples = rng.random((MAX_REPETITIONS, SAMPLED)) * 0.6  # a walk has read half of its string by then
    by_size: dict[int, list[int]] = {}
    for k, item in index.items.items():
        by_size.setdefault(len(item), []).append(k)
    for n, own in sorted(by_size.items()):
        if edit_limit(n, similarity):
            met = np.logical_or.accumulate(_simulated(index, own, rng), axis=1).mean(axis=0)
            enough = np.flatnonzero(met >= recall)
            index.repetitions[n] = int(enough[0]) + 1 if len(enough) else 0
            index.recalls[n] = float(met[enough[0]]) if len(enough) else 1.0
        else:  # equal strings agree in any repetition
            index.repetitions[n], index.recalls[n] = 1, 1.0
        for r, codes in enumerate(_codes(index, np.stack([index.items[k] for k in own]), index.repetitions[n])):
            table = index.tables.setdefault((n, r), {})
            for k, code in zip(own, codes.tolist()):
                table.setdefault(code, []).append(k)
    return index


def _windows(index: Index, ids: np.ndarray, doc: np.ndarray) -> dict[int, dict[tuple[int, int], set[int]]]:
    """{size: {(document, begin): items}} over the concatenated words of a
    batch; 0 stands for a word that no item has. The items that laid a window
    are only listed for sizes that are verified without sampling."""
    out: dict[int, dict[tuple[int, int], set[int]]] = {}
    for q, (keys, first, count, postings) in index.grams.items():
        if len(ids) < q:
            continue
        key, ok = gram_keys(ids, q), np.ones(len(ids) - q + 1, bool)
        for j in range(q):
            ok &= ids[j : len(ok) + j] > 0
        ok &= doc[: len(ok)] == doc[q - 1 :]
        at = np.flatnonzero(ok)
        slot = np.searchsorted(keys, key[at])
        hit = (slot < len(keys)) & (keys[np.minimum(slot, len(keys) - 1)] == key[at])
        at, slot = at[hit], slot[hit]
        if not len(at):
            continue
        each = count[slot]
        ends = np.cumsum(each)
        rows = np.repeat(first[slot] - (ends - each), each) + np.arange(ends[-1])
        place, item, offset = np.repeat(at, each), postings[rows, 0], postings[rows, 1]
        pair = doc[place].astype(np.int64) * (len(index.names) + 1) + item
        order = np.lexsort((offset, pair))
        pair, item, place, offset = pair[order], item[order], place[order], offset[order]
        begin = np.flatnonzero(np.diff(pair, prepend=-1))
        new = np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(offset) != 0)))
        kinds = np.add.reduceat(new.astype(np.int64), begin)  # different q-grams of the item in the document
        need = np.array([index.shared[k] for k in item[begin].tolist()])
        keep = np.repeat(kinds >= need, np.diff(begin, append=len(pair)))
        for d, k, s in zip(doc[place[keep]].tolist(), item[keep].tolist(), (place[keep] - offset[keep]).tolist()):
            n = len(index.items[k])
            laid = out.setdefault(n, {}).setdefault((d, s), set())
            if not index.repetitions[n]:
                laid.add(k)
    return out


def find(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, words) of the best stretch of each
    contaminated text and item."""
    get, parts, lengths = index.vocabulary.get, [], []
    for t in texts:
        found = words_of(t)
        lengths.append(len(found))
        parts.append(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    starts = np.cumsum(lengths) - lengths
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n, laid in _windows(index, ids, doc).items():
        spots = sorted(laid)
        for chunk in range(0, len(spots), 4096):
            part = spots[chunk : chunk + 4096]
            at = np.array([s for _, s in part])[:, None] + np.arange(n)
            owner = np.array([d for d, _ in part])
            low, high = starts[owner][:, None], (starts + lengths)[owner][:, None]
            rows = np.where((at >= low) & (at < high), ids[np.clip(at, 0, len(ids) - 1)], 0)
            codes = _codes(index, rows, index.repetitions[n]) if index.repetitions[n] else ()
            met = {(w, k) for w, spot in enumerate(part) for k in laid[spot]}
            for r in range(len(codes)):
                table = index.tables[n, r]
                for w, code in enumerate(codes[r].tolist()):
                    for k in table.get(code, ()):
                        met.add((w, k))
            for w, k in sorted(met):
                d, s = part[w]
                limit = edit_limit(n, index.similarity)
                if best.get((d, k), (limit + 1,))[0] == 0:
                    continue
                a, b = max(int(starts[d]), s - limit), min(int(starts[d] + lengths[d]), s + n + limit)
                distance, i, j = best_stretch(index.items[k], ids[a:b])
                if distance <= limit:
                    found = (distance, a + i - int(starts[d]), j - i)
                    best[d, k] = min(best.get((d, k), found), found)
    return [(d, k, *x) for (d, k), x in sorted(best.items())]


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per contaminated row of `docs` and item: the columns `keep`,
    `item_id`, `distance` (word edits), `similarity`, `first_word` and
    `n_words` of the closest stretch. Null, empty and wordless texts and items
    match nothing; repeated rows and items are reported each; an empty table
    gives no rows. Texts are read whole."""
    spark = docs.sparkSession
    slim = items.select(F.col(item_id).alias("name"), F.col(item_text).cast("string").alias("text"))
    blocks = max(1, -(-slim.count() // BLOCK_ITEMS))
    source = python_ready(docs).select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    kind = slim.schema["name"].dataType.simpleString()
    parts = []
    for block in range(blocks):
        # a bounded block: about BLOCK_ITEMS items by a hash of their id and text
        rows = slim.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r["name"] is None, r["name"] or 0, r["text"] or ""))
        names = pa.array([r["name"] for r in rows])
        index = spark.sparkContext.broadcast(build_index([r["name"] for r in rows], [r["text"] for r in rows], similarity))

        def run(batches, index=index, names=names):
            for b in batches:
                found = find(index.value, b.column(len(keep)).to_pylist())
                if not found:
                    continue
                at, item, distance, first, count = (list(x) for x in zip(*found))
                alike = [1 - d / len(index.value.items[k]) for d, k in zip(distance, item)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(at)) for c in b.columns[: len(keep)]), names.take(pa.array(item)), *(pa.array(x, pa.int32()) for x in (distance,)), pa.array(alike), *(pa.array(x, pa.int32()) for x in (first, count))],
                    names=[*keep, "item_id", "distance", "similarity", "first_word", "n_words"],
                )

        parts.append(source.mapInArrow(run, f"{kinds}{', ' if keep else ''}item_id {kind}, distance int, similarity double, first_word int, n_words int"))
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the rows that hold an item. Every column stays as it is."""
    rows = numbered(docs, "__row")
    bad = stored(contamination(rows, items, ["__row"], text).select("__row").distinct())
    return rows.join(bad, "__row", "left_anti").select(*docs.columns)
