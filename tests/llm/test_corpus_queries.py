"""The registered queries against DuckDB, and the pipeline against its stages' own rules."""

import html
import os
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from driftline.llm import mixing, queries
from driftline.session import release

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_duckdb(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.queries()[name](spark, SF)
    want = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    show = lambda cols, rows: sorted(tuple(repr(r[cols.index(n)]) for n in order) for r in rows)
    assert show(got.columns, [tuple(r) for r in got.collect()]) == show(names, want.fetchall())


def test_html_extraction_gives_the_articles(spark):
    """The given pages close what matters, so that their articles can be cut out by hand."""
    pages = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.queries()["op12_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        url, page = pages[r["page_id"]]
        blocks = re.split("<p>|</p>|<h1>|</h1>", page.split("<article>")[1].split("</article>")[0])
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert (r["url"], r["text"], r["n_chars"]) == (url, text := "\n\n".join(w for w in want if w), len(text))


def test_one_query_an_operator():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.toPandas())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    start = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(kept[0]) == start["text"].str.contains(r"[^\W\d_]").sum()
    lower = kept[0]["text"].str.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert set(kept[1]["doc_id"]) == set(kept[0].groupby(lower)["doc_id"].max())

    sets = {}
    for r in kept[1].itertuples():
        w = r.text.encode().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert set(kept[2]["doc_id"]) == set(root.values())

    times = kept[3].groupby("doc_id").size()
    assert times.max() <= 2 and set(times.index) <= set(kept[2]["doc_id"])
    size = kept[3]["text"].map(lambda t: len(t.encode().split()))
    whole = kept[2]["text"].map(lambda t: len(t.encode().split())).sum()
    assert abs(size.sum() - 1.5 * whole) < 0.15 * whole
    tokens = defaultdict(int)
    for r in kept[4].itertuples():
        tokens[r.doc_id] += r.length
    first = kept[4].groupby("doc_id")["doc_tokens"].first()
    assert all(tokens[i] == first[i] * times[i] for i in times.index)


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_released_driver_keeps_no_unused_native_memory(spark):
    jvm = spark.sparkContext._jvm
    own = jvm.java.lang.ProcessHandle.current().pid()

    def native():
        heap = jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage().getCommitted() / 2**20
        kept = int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{own}/smaps_rollup").read_text())[1]) / 1024
        return kept, heap

    found = [jvm.java.util.zip.Deflater() for _ in range(1000)]  # each some 130 kB that the C library deals out
    for i, x in enumerate(found):
        if i % 50:
            x.end()
    jvm.System.gc()
    before, heap = native()
    release(spark)
    after, heap_after = native()
    assert before - after > 60 + max(0, heap - heap_after)


def test_pipeline_keeps_texts_without_a_language_model(spark, docs):
    rows = docs.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.keep_known_languages(spark, rows, SF)
    assert sorted(r["text"] for r in got.collect()) == sorted(r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_pipeline_stages_with_null_and_repeated_ids(spark, docs):
    """Stages decide on rows: nothing is lost, kept or multiplied because ids are null or repeat."""
    passage = [f"w{i}" for i in range(60)]
    near = lambda *places: " ".join(f"x{i}" if i in places else w for i, w in enumerate(passage))
    own = lambda k: " ".join(f"{k}v{i}" for i in range(30))
    rows = [(None, own("a")), (None, own("b")), (None, own("a")), (2000, own("b")), (2001, own("c")), (2001, own("d")), (2002, own("c")), (None, near(59)), (2003, near()), (2004, near(0)), (2001, own("e")), (2001, own("e").upper())]
    more = spark.createDataFrame([(i, t, "en", "s0", len(t), "x", 1, "k", "z", "b", "n", "p", 2, "d", "s") for i, t in rows], docs.schema)
    start = docs.unionByName(more)
    lower = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    # columns that bear the names of a stage's own
    start = start.withColumns({"score": F.lit(0.25), "lang_pred": F.lit("mine"), "row": F.lit(7), "digest2": F.lit("x"), "repeats": F.lit(9), "root": F.lit("r")})
    for stage in (f for _, f in corpus_pipeline.STAGES[:-1]):
        out = stage(spark, start, SF)
        assert out.columns == start.columns and out.select("score", "lang_pred", "row", "repeats", "root").distinct().collect() == [(0.25, "mine", 7, 9, "r")]
        assert stage(spark, start.limit(0), SF).count() == 0

    known = corpus_pipeline.keep_known_languages(spark, start, SF)
    assert Counter(r["text"] for r in known.collect()) == Counter(r["text"] for r in start.collect() if any(c.isalpha() for c in r["text"] or ""))

    one = corpus_pipeline.keep_one_of_equals(spark, start, SF)
    got = Counter((r["doc_id"], lower(r["text"])) for r in one.collect())
    largest = {}
    for r in start.collect():
        t, i = lower(r["text"]), r["doc_id"]
        largest[t] = max(largest.get(t, -1), -1 if i is None else i)
    assert got == Counter((None if i == -1 else i, t) for t, i in largest.items())

    one = one.cache()
    kept = corpus_pipeline.keep_one_of_near_copies(spark, one, SF)
    before = [((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "")) for r in one.collect()]
    sets = []
    for _, t in before:
        w = t.encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()})
    root = list(range(len(sets)))
    for _ in range(3):
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    low = min(root[a], root[b])
                    root = [low if r in (root[a], root[b]) else r for r in root]
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, []).append(before[i])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted(min(x) for x in least.values())
    assert (-1, near(59)) in {min(x) for x in least.values()} and any(len(x) > 2 for x in least.values())

    plan = {(r["doc_id"], r["source"]): r["repeats"] for r in mixing.mix_sources(start).collect()}
    want = Counter()
    for r in start.collect():
        want[r["doc_id"], r["source"], r["text"]] += plan[r["doc_id"], r["source"]]
    got = Counter((r["doc_id"], r["source"], r["text"]) for r in corpus_pipeline.mix(spark, start, SF).collect())
    assert got == +want and any(i is None for i, _, _ in got)
