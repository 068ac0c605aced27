"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: words of the lower-cased text, shingles of `width` words, XXH64
of each; a bit is 1 if more than half of the hashes set it.

Search for fingerprints within `max_distance` bits:
1. Correlated bits go into one partition (greedy, from the bit co-occurrence
   of all distinct fingerprints).
2. If the thresholds t_i of m partitions sum to max_distance - m + 1 (-1: the
   partition isn't probed), two close fingerprints differ by at most t_i bits
   in some partition i. Each fingerprint gets its own thresholds by dynamic
   programming over the estimated candidates of each (partition, threshold);
   the estimate convolves histograms of all fingerprints' sub-blocks. The
   number of partitions is the one with the least estimated work in total.
3. Every fingerprint is indexed under its value in each partition and probes
   the values within t_i bits of its own; a hit is verified by Hamming distance.
4. A bucket in which a group of near copies would make many pairs isn't
   paired: two members are within 2r bits exactly if they share a point within
   r bits of both, so each member names its points and members that name the
   same one are linked to the smallest of them. That is exact and grows with
   the members, not with their square.

Work runs on distinct fingerprints, so exact copies cost one row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import cut, numbered, python_ready, stored
from halyard.llm.components import connected_components

BITS = 64
SEED = 42
#: Candidate pairs of a bucket above which its members are linked by shared points instead.
HEAVY_PAIRS = 4096
#: Estimated cost of one probe, in verified candidates.
PROBE_COST = 2.0
#: Partition counts that are considered.
PARTITIONS = (1, 2, 3, 4)
#: Widest sub-block of a partition that has a histogram of its own.
SUB_BITS = 11


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text; 0 for null, empty or blank."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.concatenate(([0], ends[: -width] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[b:e], SEED) for b, e in zip(begins, ends[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """The columns `keep` of every row, and `__fp` (signed long)."""

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t, width) for t in b.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found)], names=[*keep, "__fp"])

    source = python_ready(docs).select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{kinds}, `__fp` long")


def _rows(batches):
    for b in batches:
        yield b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _co_occurrence(batches):
    total = np.zeros((BITS, BITS))
    for fps in _rows(batches):
        x = _bit_matrix(fps).astype(np.float32)
        total += x.T @ x
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i * BITS + j), pa.array(total[i, j].astype(np.int64))], names=["k", "c"])


def group_bits(co: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of the bits, of even widths; each grows by the bit that
    correlates most with those it has."""
    p = np.diag(co) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(co / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, parts = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        own = [max(free, key=lambda b: (sum(corr[b, c] for c in free if c != b), -b))]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: (corr[b, own].mean(), -b)))
            free.remove(own[-1])
        parts.append(own)
    return parts


def _sub_blocks(parts: list[list[int]]) -> list[list[list[int]]]:
    out = []
    for bits in parts:
        k = -(-len(bits) // SUB_BITS)
        out.append([list(map(int, x)) for x in np.array_split(bits, k)])
    return out


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    value = np.zeros(len(fps), np.int64)
    for at, b in enumerate(bits):
        value |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << at
    return value


class Plan:
    """Partitions and estimates for one number of partitions."""

    def __init__(self, parts: list[list[int]], tau: int):
        self.parts, self.tau, self.m = parts, tau, len(parts)
        self.subs = _sub_blocks(parts)
        self.near: list[list[np.ndarray]] = []  # [partition][sub-block]: share of rows at distance 0..tau, by value

    def fit(self, counts: dict[tuple[int, int], np.ndarray], n: int) -> None:
        self.n = n
        for i, subs in enumerate(self.subs):
            own = []
            for s, bits in enumerate(subs):
                hist, values = counts[i, s] / max(n, 1), np.arange(1 << len(bits))
                own.append(np.stack([
                    sum((hist[values ^ sum(1 << b for b in flip)] for flip in combinations(range(len(bits)), d)), np.zeros(len(hist)))
                    for d in range(self.tau + 1)
                ]))
            self.near.append(own)

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """(partition, threshold + 1, row): estimated work; threshold -1 is free."""
        out = np.zeros((self.m, self.tau + 2, len(fps)))
        for i, subs in enumerate(self.subs):
            at = np.zeros((self.tau + 1, len(fps)))
            at[0] = 1
            for s, bits in enumerate(subs):
                own = self.near[i][s][:, _gather(fps, bits)]
                at = np.stack([sum(at[a] * own[d - a] for a in range(d + 1)) for d in range(self.tau + 1)])
            probes = 0
            for t in range(self.tau + 1):
                probes += len(list(combinations(range(len(self.parts[i])), t)))
                out[i, t + 1] = self.n * at[: t + 1].sum(axis=0) + PROBE_COST * probes
        return out

    def allocate(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds (partition, row) that sum to tau - m + 1 at least cost,
        and that cost: dynamic programming over the partitions; the state is
        the sum of (threshold + 1), which has to reach tau + 1."""
        costs, goal, rows = self.costs(fps), self.tau + 1, np.arange(len(fps))
        best = np.full((goal + 1, len(fps)), np.inf)
        best[0] = 0
        chosen = []
        for i in range(self.m):
            options = np.full((goal + 1, goal + 1, len(fps)), np.inf)  # [sum, own]
            for total in range(goal + 1):
                for own in range(total + 1):
                    options[total, own] = best[total - own] + costs[i, own]
            chosen.append(options.argmin(axis=1))
            best = options.min(axis=1)
        total, out = np.full(len(fps), goal), np.zeros((self.m, len(fps)), np.int64)
        for i in reversed(range(self.m)):
            out[i] = chosen[i][total, rows]
            total = total - out[i]
        return out - 1, best[goal]


def _flips(bits: list[int], most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in flip) for d in range(most + 1) for flip in combinations(bits, d)], np.uint64)


def _keys(plan: Plan):
    """Index and probe rows (part, value, fp, probe) of distinct fingerprints."""
    masks = [np.uint64(sum(1 << b for b in bits)) for bits in plan.parts]
    flips = [[_flips(bits, t) for t in range(plan.tau + 1)] for bits in plan.parts]

    def run(batches):
        for fps in _rows(batches):
            for at in range(0, len(fps), 4096):
                block = fps[at : at + 4096]
                thresholds, _ = plan.allocate(block)
                for i in range(plan.m):
                    own = block & masks[i]
                    sets = [(own, block, False)]
                    for t in range(plan.tau + 1):
                        if (take := thresholds[i] == t).any():
                            values = (own[take][:, None] ^ flips[i][t][None, :]).ravel()
                            sets.append((values, np.repeat(block[take], len(flips[i][t])), True))
                    for values, fp, probe in sets:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(fp), i, np.int32)), pa.array(values.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), probe))],
                            names=["part", "value", "fp", "probe"],
                        )

    return run


def plan_search(distinct: DataFrame, tau: int) -> Plan:
    """Statistics over all fingerprints; what comes to the driver is 2,080
    counters of bit pairs and the histograms, 2^11 counters a sub-block."""
    n = distinct.count()
    co = np.zeros((BITS, BITS))
    for r in distinct.mapInArrow(_co_occurrence, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        i, j = divmod(r["k"], BITS)
        co[i, j] = co[j, i] = r["c"]
    plans = [Plan(group_bits(co, n, m), tau) for m in PARTITIONS if m <= tau + 2]
    blocks = [(p, i, s, bits) for p, plan in enumerate(plans) for i, subs in enumerate(plan.subs) for s, bits in enumerate(subs)]

    def histograms(batches):
        found = [np.zeros(1 << len(bits), np.int64) for *_, bits in blocks]
        for fps in _rows(batches):
            for k, (*_, bits) in enumerate(blocks):
                found[k] += np.bincount(_gather(fps, bits), minlength=1 << len(bits))
        for k, x in enumerate(found):
            v = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(x[v])], names=["k", "v", "c"])

    counts = {(p, i, s): np.zeros(1 << len(bits)) for p, i, s, bits in blocks}
    for r in distinct.mapInArrow(histograms, "k int, v long, c long").groupBy("k", "v").agg(F.sum("c").alias("c")).collect():
        counts[blocks[r["k"]][:3]][r["v"]] = r["c"]
    for p, plan in enumerate(plans):
        plan.fit({(i, s): c for (q, i, s), c in counts.items() if q == p}, n)

    def work(batches):
        total = np.zeros(len(plans))
        for fps in _rows(batches):
            for at in range(0, len(fps), 4096):
                total += [plan.allocate(fps[at : at + 4096])[1].sum() for plan in plans]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(plans), dtype=np.int32)), pa.array(total)], names=["k", "work"])

    least = distinct.mapInArrow(work, "k int, work double").groupBy("k").agg(F.sum("work").alias("work")).collect()
    return plans[min(least, key=lambda r: (r["work"], r["k"]))["k"]] if least else plans[0]


def near_links(distinct: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those
    groups which pairs within `tau` bits connect."""
    keys = distinct.mapInArrow(_keys(plan_search(distinct, tau)), "part int, value long, fp long, probe boolean")
    sizes = (
        keys.groupBy("part", "value")
        .agg(F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("indexed"), F.min("fp").alias("low"), F.max("fp").alias("high"))
        .filter("low <> high and probes > 0 and indexed > 0")
        .select("part", "value", (F.col("probes") * F.col("indexed")).alias("pairs"))
    )
    sizes = cut(sizes)
    heavy = F.col("pairs") > HEAVY_PAIRS if tau % 2 == 0 else F.lit(False)
    light = keys.join(sizes.filter(~heavy).select("part", "value"), ["part", "value"])
    a, b = light.filter("probe").alias("a"), light.filter(~F.col("probe")).alias("b")
    pairs = a.join(
        b,
        (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") != F.col("b.fp"))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= tau),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if tau % 2:
        return pairs
    flips = _flips(list(range(BITS)), tau // 2).view(np.int64).tolist()
    members = keys.join(sizes.filter(heavy).select("part", "value"), ["part", "value"]).select("fp").distinct()
    points = members.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).filter("hub <> last").select("point", "hub")
    stars = points.join(hubs, "point").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, keep: list[str], order: str = "doc_id", text: str = "text", width: int = 3, max_distance: int = 2) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, `fingerprint` (16
    lower-case hex digits) and `component_id`: the smallest `order` value that
    links of at most `max_distance` bits reach, its own included.

    Null, empty and blank texts have fingerprint zero and link like others. A
    row with a null `order` belongs to a component but never names it (a
    component of such rows alone has a null id). Repeated rows come back each.
    """
    marked = stored(fingerprints(docs, keep, text, width))
    distinct = cut(marked.groupBy("__fp").agg(F.min(order).alias("first")))
    groups = connected_components(near_links(distinct.select("__fp"), max_distance), "a", "b")
    rooted = distinct.join(groups.withColumnRenamed("node", "__fp"), "__fp", "left").select("__fp", "first", F.coalesce("root", "__fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("__fp", "component_id")
    return marked.join(named, "__fp").select(*keep, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, max_distance: int = 2) -> DataFrame:
    """`docs` with one row of each near-duplicate group: the one with the
    smallest id (nulls last, the earliest row among equals). Every column
    stays as it is."""
    rows = numbered(docs, "__row")
    # the component is named by row here, so that null and repeated ids stay apart
    slim = rows.select("__row", F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    ranked = slim.withColumn("__rank", F.struct(F.col("__id").isNull().alias("late"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    found = near_duplicates(ranked, ["__row", "__rank"], "__rank", "__text", width, max_distance)
    losers = stored(found.filter(F.col("component_id.row") != F.col("__row")).select("__row"))
    return rows.join(losers, "__row", "left_anti").select(*docs.columns)
