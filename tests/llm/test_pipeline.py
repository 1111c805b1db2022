"""The pipeline's stages on planted cases and awkward tables."""

import collections
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

pytest.importorskip("foliospark.llm")
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from test_llm_operators import edits_between, sequential_best_fit, union_find  # noqa: E402

from foliospark.llm import quality, queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def passage(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, DATA)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count(), name
        assert after.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == docs.count()


def test_awkward_rows_pass(spark):
    rows = table(spark, [(1, None), (2, ""), (None, "some words"), (3, "x y z"), (3, "x y z"), (3, "another text")])
    for docs in (rows, rows.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            step(spark, docs, DATA).collect()


def test_near_copies_leave_one(spark):
    words = [f"word{k}" for k in range(120)]
    near = words[:60] + ["changed"] + words[61:]
    rows = table(spark, [(5, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (4, "an unrelated text of its own"), (None, " ".join(words)), (4, "an unrelated text of its own")])
    left = sorted((r["doc_id"] is None, r["doc_id"]) for r in stage("n-gram Jaccard join")(spark, rows, DATA).collect())
    assert left == [(False, 2), (False, 4), (True, None)]


def test_rows_of_one_id_stand_by_their_own_text(spark):
    words = [f"word{k}" for k in range(120)]
    text, near = " ".join(words), " ".join(words[:60] + ["changed"] + words[61:])
    other, third = " ".join(f"other{k}" for k in range(40)), " ".join(f"third{k}" for k in range(40))
    rows = [(3, text), (3, other), (2, near), (7, third), (7, third + " end"), (8, None), (8, None), (8, ""), (8, ""), (9, "")]
    rows += [(None, text), (None, near), (None, other + " x"), (None, other + " x"), (None, "alone without a name"), (None, ""), (None, "")]
    left = stage("n-gram Jaccard join")(spark, table(spark, rows), DATA).select("doc_id", "text").collect()
    found = {(r["doc_id"], r["text"]) for r in left if r["doc_id"] != 7 and r["text"] not in (text, near)}
    assert found == {(3, other), (8, None), (8, ""), (9, ""), (None, other + " x"), (None, "alone without a name"), (None, "")}
    assert len(left) == len(found) + 3
    assert [r["text"] for r in left if r["doc_id"] == 2] == [near]
    assert sum(r["doc_id"] == 7 for r in left) == 1
    assert sum(r["doc_id"] is None and r["text"] in (text, near) for r in left) == 1


def test_benchmark_passages_go(spark, passage):
    rows = table(spark, [(1, "before words stay " + passage + " after words stay"), (2, "a clean text"), (3, passage)])
    left = {r["doc_id"]: r["text"] for r in stage("benchmark decontamination")(spark, rows, DATA).collect()}
    assert set(left) == {1, 2} and left[2] == "a clean text"
    assert left[1].startswith("before words stay") and left[1].endswith("after words stay") and passage not in left[1]


def test_lines_go_once(spark):
    line = "a line of boilerplate that many documents share with others"
    rows = table(spark, [(1, line + "\nfirst text"), (2, "second text\n" + line.replace("many", "mamy")), (3, line)])
    left = {r["doc_id"]: r["text"] for r in stage("line dedup")(spark, rows, DATA).collect()}
    assert left == {1: line + "\nfirst text", 2: "second text"}


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, DATA)
    wanted = kept.select("doc_id").distinct()
    found = queries.queries()["pipeline"](spark, DATA)
    assert found.select("doc_id").distinct().exceptAll(wanted).isEmpty() and wanted.exceptAll(found.select("doc_id").distinct()).isEmpty()
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def brute_pipeline(docs, marks, items, tokenizer):
    """The five stages written out over (id, text): densities, all pairs of lines, all pairs of sets, all windows, sequential best fit."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    x = {i: np.array(quality.statistics(t.encode())) for i, t in docs}
    of = [np.array([x[i] for i, y in marks.items() if i in x and y == c and zlib.crc32(str(i).encode()) % 4 != 2]) for c in (0, 1)]
    scatter = [(a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) for a in of]
    pooled = np.diag(np.diag(sum(scatter)) / (len(of[0]) + len(of[1])) + 1e-6)

    def density(c, v):
        cov = (1 - quality.SHRINKAGE) * scatter[c] / len(of[c]) + quality.SHRINKAGE * pooled
        d = v - of[c].mean(axis=0)
        return -0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * np.linalg.slogdet(cov)[1]

    odds = {i: (density(1, x[i]) - density(0, x[i])) / quality.TEMPERATURE + np.log(len(of[1]) / len(of[0])) for i, _ in docs}
    docs = [(i, t) for i, t in docs if 1 / (1 + np.exp(-odds[i])) >= 0.7]

    lines = sorted({line for _, t in docs for line in t.split("\n") if len(line) >= 20}, key=len)
    letters = [collections.Counter(line) for line in lines]
    close = []
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            if len(lines[b]) - len(lines[a]) > 2:
                break
            if sum(((letters[a] - letters[b]) | (letters[b] - letters[a])).values()) <= 4 and edits_between(lines[a], lines[b]) <= 2:
                close.append((lines[a], lines[b]))
    top, seen, left = union_find(lines, close), {}, []
    for i, t in sorted(docs):
        kept = [line for k, line in enumerate(t.split("\n")) if len(line) < 20 or seen.setdefault(top[line], (i, k)) == (i, k)]
        text = "\n".join(kept)
        if text == t or re.search(corpus_pipeline.WORD, text):
            left.append((i, text))
    docs = left

    sets = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(lower))
        sets.append({tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set())
    pairs = [(a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = union_find(range(len(docs)), pairs)
    docs = [d for k, d in enumerate(docs) if top[k] == k]  # by id, so the least of a group is its top

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for text in items:
        w = word.findall(text.translate(lower))
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9))} if w else set()
    left = []
    for i, t in docs:
        found = [(m.start(), m.end()) for m in word.finditer(t.translate(lower))]
        w = [t.translate(lower)[a:b] for a, b in found]
        hit = {p for n in {len(g) for g in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        out, at = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out.append(t[at : found[k][0]])
            at = found[k][1]
        text = "".join([*out, t[at:]])
        if not hit or re.search(corpus_pipeline.WORD, text):
            left.append((i, text))

    pieces = []
    for i, t in left:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        pieces += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(pieces), sequential_best_fit([p[3] for p in pieces], 2048)


def test_run_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    small = DATA.replace("0.001", "0.01")
    source = spark.read.parquet(f"{small}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    bad = labels.where("quality = 0").select("doc_id").withColumn("bad", F.lit(True))
    rows = source.join(bad, "doc_id", "left").where("doc_id < 300 and n_chars < 900 or bad and n_chars < 3000").orderBy("doc_id").collect()
    items = [r["text"] for r in benchmark.collect()]
    docs = [(r["doc_id"], r["text"]) for r in rows]
    good = [t for _, t in docs if len(t) > 400][:6]
    docs += [(1000 + k, t) for k, t in enumerate(good)] + [(1010 + k, " ".join(t.split(" ")[:-1])) for k, t in enumerate(good)]
    docs += [(1020 + k, t[: len(t) // 2] + " " + items[k] + " " + t[len(t) // 2 :]) for k, t in enumerate(good)]
    docs += [(1030 + k, t + "\n" + "A line of boilerplate, shared by all of these" + "!" * k) for k, t in enumerate(good[:3])]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    wanted, sequences = brute_pipeline(docs, marks, items, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    assert len({r["sequence_id"] for r in found}) == sequences
    assert 0 < len({p[0] for p in wanted}) < len(docs)


def test_clashing_columns_and_long_texts_pass(spark):
    extra = "folio_row long, folio_t string, folio_x int, folio_kept_text string, folio_removed int, folio_spans int, cls int"
    rows = [(1, "long text of words " * 6000, "en", "s", 114_000, 1, "a", 2, "b", 3, 4, 5), (2, "x" * 80_000, "en", "s", 80_000, 1, "a", 2, "b", 3, 4, 5)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    for name, step in corpus_pipeline.STAGES[:2]:
        after = step(spark, docs, DATA)
        assert after.columns == docs.columns, name
        after.collect()
    assert stage("n-gram Jaccard join")(spark, docs, DATA).columns == docs.columns
    assert stage("best-fit packing")(spark, docs, DATA).select("doc_id").distinct().count() == 2
