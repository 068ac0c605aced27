"""File splits follow the cores at hand. Here every write changes them, as an
executor lost or added between two jobs does; the results must not change."""

import pytest

from halyard.llm import common, decontam, lines, pii, simhash

SPLIT = "spark.sql.files.maxPartitionBytes"
MODULES = (common, decontam, lines, pii, simhash)


@pytest.fixture
def shaken(spark, monkeypatch):
    """`stored` that leaves other file splits behind after each write."""
    kept, write, times = spark.conf.get(SPLIT), common.stored, []

    def stored(df):
        out = write(df)
        times.append(1)
        spark.conf.set(SPLIT, str((1 << 27) if len(times) % 2 == 0 else 4096))
        return spark.read.parquet(*out.inputFiles()) if out.inputFiles() else out

    for m in MODULES:
        monkeypatch.setattr(m, "stored", stored)
    yield times
    spark.conf.set(SPLIT, kept)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """3,000 documents of small row groups: 1,000 texts, two of them in 1,001 copies each, some with an entity or a
    benchmark passage."""
    path = f"{tmp_path_factory.mktemp('rows')}/d"
    rows = []
    for k in range(3000):
        n = k % 1000 if k < 1000 else k % 2
        words = " ".join(f"w{(n * 7919 + j * 104729) % 100003}" for j in range(30))
        rows.append((k, f"{words}\nthe shared line of every document\n{'mail to a%d@b.cd' % n if n % 10 == 0 else 'nothing here'}", "en", "s", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(2).write.option("parquet.block.size", "20000").parquet(path)
    return spark.read.parquet(path)


def test_numbers_are_read_from_files(spark, copies, shaken):
    rows = common.numbered(copies, "at")
    first = dict(rows.select("doc_id", "at").collect())
    parts = rows.rdd.getNumPartitions()
    spark.conf.set(SPLIT, str(1 << 27) if spark.conf.get(SPLIT) == "4096" else "4096")
    again = spark.read.parquet(*rows.inputFiles())
    assert again.rdd.getNumPartitions() != parts
    assert dict(again.select("doc_id", "at").collect()) == first and len(set(first.values())) == 3000


def test_near_copies(copies, shaken):
    assert sorted(r[0] for r in simhash.keep_first(copies).select("doc_id").collect()) == list(range(1000))
    assert shaken


def test_lines(copies, shaken):
    out = {r["doc_id"]: r["text"] for r in lines.keep_lines(copies).collect()}
    assert sum("the shared line" in t for t in out.values()) == 1
    assert sorted(out) == list(range(1000))


def test_contaminated(spark, copies, shaken):
    item = copies.filter("doc_id = 1").first()["text"].split("\n")[0]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = sorted(r[0] for r in decontam.drop_contaminated(copies, items).select("doc_id").collect())
    assert left == [k for k in range(3000) if k != 1 and not (k >= 1000 and k % 2 == 1)]


def test_sanitised(copies, shaken):
    before = {r["doc_id"]: r["text"] for r in copies.collect()}
    for r in pii.sanitise(copies).collect():
        assert ("@" in before[r["doc_id"]]) == ("[EMAIL]" in r["text"]) and "@" not in r["text"]
