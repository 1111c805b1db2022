"""Each operator against a brute-force version or an exact round trip, on small and awkward tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

pytest.importorskip("foliospark.llm")
import public_tokenizers  # noqa: E402

from foliospark.llm import _common, chat_rotation, decontaminate, line_dedup, link_graph, ngram_join, packing, quality, queries, shard, token_count, weak_rules  # noqa: E402

LINE = "the quick brown fox jumps over the lazy dog near the old river bank today"
AWKWARD = [
    (1, LINE + "\n" + LINE), (2, LINE.replace("quick", "quack")), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (6, "one"), (7, "é漢字 😀 " * 9),
    (None, "no id here but some words to hold on to"), (8, "x" * 70_000), (9, "w " * 20_000), (10, LINE), (11, "A B c\x00d|e\n\n" + "#$% " * 30), (12, LINE.upper()),
]
CLASH = "doc_id long, text string, id string, cls string, folio_text string, folio_size string, keys string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", None, "b", "c", "d") for i, t in AWKWARD]
    return spark.createDataFrame(rows, CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    found, wanted = queries.queries()[name](spark, DATA).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2040)]
    found = {r["node"]: r["component"] for r in _common.connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "u long, v long")).collect()}
    wanted = union_find({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: wanted[n] for n in linked}


# 1: chat rotation


def test_rotation_reassembles(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", "x"), (1, 600, "ann", "é"), (2, None, None, "q"), (3, 0, "system", "alone"), (None, 0, "ann", "z")]
    rows = chat_rotation.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    views = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["position"]):
        views[(r["conv"], r["perspective"])].append(r)
    assert {k: len(v) for k, v in views.items()} == {(1, "ann"): 5, (1, "bob"): 5, (2, "unknown"): 1, (None, "ann"): 1}
    for (_, who), view in views.items():
        whole = "".join(r["rendered"] for r in view)
        assert [r["position"] for r in view] == list(range(len(view)))
        for r in view:
            assert whole[r["char_start"] :].startswith(r["rendered"])
            assert (r["train_start"] is not None) == (r["speaker"] == who) == (r["chat_role"] == "assistant")
            if r["train_start"] is not None:
                assert whole[r["train_start"] : r["train_end"]].endswith("<|end|>\n")


# 2: token counts


def test_counts_equal_the_tokenizers_library(spark, docs, corpus):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    exact = Tokenizer(models.Unigram(token_count.piece_vocabulary(path), 0, True))
    for table in (docs, corpus.where("doc_id < 60")):
        for n, text in _pairs(token_count.count_tokens(table, path), table):
            assert n == (len(exact.encode(token_count.MARK + text.replace(" ", token_count.MARK)).ids) if text else 0)


def _pairs(counted, table):
    by = collections.defaultdict(list)
    for r in counted.collect():
        by[r["id"]].append(r["n_tokens"])
    texts = collections.defaultdict(list)
    for r in table.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(r["text"])
    assert {k: len(v) for k, v in by.items()} == {k: len(v) for k, v in texts.items()}
    return [(n, t) for k in by for n, t in zip(by[k], texts[k], strict=True)]


def test_tie_rules_on_random_vocabularies():
    from tokenizers import Tokenizer, models

    rng = random.Random(5)
    for _ in range(60):
        vocab = [("<unk>", 0.0)] + [(p, float(-rng.randint(1, 4))) for p in sorted({"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))) for _ in range(12)})]
        mine, exact = token_count.UnigramCounter(vocab, False), Tokenizer(models.Unigram(vocab, 0, False))
        for _ in range(20):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 25)))
            assert mine.count(text)[0] == len(exact.encode(token_count.MARK + text.replace(" ", token_count.MARK)).ids), (vocab, text)


# 3: decontamination


def test_decontamination(spark, docs, empty):
    items = [(1, LINE), (2, "one"), (3, None), (4, ""), (5, "brown fox"), (5, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").encode().lower())
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            wins[tuple(w[k : k + min(10, len(w))])].add(str(i))
    rows = decontaminate.find_contamination(docs, bench).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        w = word.findall((r["text"] or "").encode().lower())
        hit, names = set(), set()
        for g, owners in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    names |= owners
        assert r["folio_words"] == len(w) and r["folio_items"] == sorted(names)
        assert {x for s in r["folio_spans"] for x in range(s["first"], s["last"] + 1)} == hit
    cut = decontaminate.remove_spans(decontaminate.find_contamination(docs, bench))
    assert LINE.encode() not in b"".join((r["text"] or "").encode() for r in cut.collect())
    assert decontaminate.find_contamination(empty, bench).count() == 0
    none = decontaminate.find_contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(AWKWARD) and not any(r["folio_spans"] for r in none)


def test_benchmark_items_without_a_name(spark, tmp_path):
    """Their passages are hit, as in the query's SQL, where all of them are one item without a name."""
    import duckdb

    first, second, third = (" ".join(f"{w}{k}" for k in range(12)) for w in "abc")
    spark.createDataFrame([(1, f"x {first} y"), (2, f"{second} and {first}"), (3, f"{third} {second}"), (4, "clean text"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, first), (None, second), (7, third), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = queries.op3_decontaminate(spark, str(tmp_path)).toPandas()
    assert rows_of(found) == rows_of(duck.execute(queries.oracle_sql()["op3_decontaminate"]).df())
    assert found.set_index("doc_id")["n_hit"].to_dict() == {1: 12, 2: 24, 3: 24, 4: 0, 5: 0}
    items = decontaminate.find_contamination(queries.table(spark, str(tmp_path), "documents"), queries.table(spark, str(tmp_path), "benchmark")).collect()
    assert {r["doc_id"]: r["folio_items"] for r in items} == {1: [None], 2: [None], 3: ["7", None], 4: [], 5: []}


def test_index_search_and_locate():
    rng = np.random.default_rng(2)
    for _ in range(60):
        seq = np.append(0, rng.integers(0, 4, rng.integers(0, 80)))
        index = decontaminate.FMIndex(seq, 3)
        for n in (1, 2, 4):
            patterns = rng.integers(1, 4, (4, n))
            for p, a, b in zip(patterns, *index.search(patterns), strict=True):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()]


# 4: sharding


def test_shards(spark, docs, corpus, empty):
    for table, shards in ((corpus, 24), (docs, 3), (docs.limit(1).crossJoin(spark.range(900).select()), 4)):
        rows = shard.shard_by_bytes(table, shards).select("folio_shard", "folio_slot", "folio_size", "doc_id").collect()
        assert len(rows) == table.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["folio_shard"]].append(r)
        assert set(by) <= set(range(shards))
        for members in by.values():
            assert sorted(r["folio_slot"] for r in members) == list(range(len(members)))
        sizes = [sum(r["folio_size"] for r in by.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 2 * max(r["folio_size"] for r in rows) + 0.01 * sum(sizes) / shards
    assert shard.shard_by_bytes(empty, 24).count() == 0


# 5: quality


def test_held_out_accuracy(spark, docs, empty):
    small = DATA.replace("0.001", "0.01")
    found = queries.op5_quality_qda(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.95 * len(found)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None), (1, 1)], "doc_id long, quality int")
    for marks in (labels, labels.limit(1), labels.limit(0)):
        out = quality.score_quality(docs, marks).collect()
        assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
        quality.keep_good(docs, marks).collect()
    assert quality.score_quality(empty, labels).count() == 0


# 6: n-gram join


def brute_components(rows, n, percent):
    sets, lower = [], str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    edges = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = union_find(range(len(rows)), edges)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top[k]] = min(low.get(top[k], i), i)
    return sorted((str(i), len(sets[k]), str(low.get(top[k]) if sets[k] else i), sum(k in e for e in edges)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "weight"), [(3, 90, None), (5, 80, None), (3, 80, 150), (2, 50, 40)])
def test_ngram_components(spark, docs, empty, monkeypatch, n, percent, weight):
    rng, rows = random.Random(7), [(i, t) for i, t in AWKWARD if t is None or len(t) < 20_000]
    for base in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([9, 30, 80, 200]))]
        for copy in range(6):
            rows.append((100 + base * 10 + copy, " ".join(w if rng.random() > copy * 0.012 else f"z{rng.randrange(9)}" for w in words)))
    if weight:
        monkeypatch.setattr(ngram_join, "NAMED_GROUP", 3)
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 2)
        monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", weight)  # many blocks: each pair of them is a task
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.ngram_components(table, n=n, percent=percent).collect()
    assert sorted((str(r["id"]), r["n_grams"], str(r["component"]), r["links"]) for r in found) == brute_components(rows, n, percent)
    assert ngram_join.ngram_components(empty, n=n, percent=percent).count() == 0
    assert ngram_join.ngram_components(docs, n=n, percent=percent).count() == len(AWKWARD)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for _ in range(150):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, max(1, len(a) * (100 - percent) // 100) + 1) :], rng.integers(0, 2**63, rng.integers(0, len(a) // 8 + 1), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_join.segment_keys(a, percent), ngram_join.segment_keys(b, percent)))


# 7: line dedup


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, text, n):
    out = list(text)
    for _ in range(n):
        p, how = rng.randrange(len(out)), rng.randrange(3)
        out[p : p + (how > 0)] = [rng.choice("abé漢 ")] if how < 2 else []
    return "".join(out)


@pytest.mark.parametrize(("edits", "named", "block"), [(1, 512, 1024), (2, 512, 1024), (3, 3, 2)])
def test_line_dedup(spark, docs, empty, monkeypatch, edits, named, block):
    monkeypatch.setattr(line_dedup, "NAMED_GROUP", named)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)  # small blocks: hot keys are dealt
    rng = random.Random(edits)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(21, 60))) for _ in range(25)]
    rows = [(k, "\n".join(mutated(rng, rng.choice(bases), rng.randint(0, 4)) for _ in range(3))) for k in range(40)] + [(i, t) for i, t in AWKWARD if t is None or len(t) < 20_000]
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits=edits).collect()
    assert len(done) == len(rows)
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if len(x) >= 20})
    top = union_find(lines, [(a, b) for a, b in itertools.combinations(lines, 2) if abs(len(a) - len(b)) <= edits and edits_between(a, b) <= edits])
    seen = {}
    order = sorted(done, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r in order:
        kept = []
        for k, x in enumerate((r["text"] or "").split("\n")):
            if len(x) >= 20:
                place = seen.setdefault(top[x], (r["doc_id"], r["text"], k))
                if place != (r["doc_id"], r["text"], k):
                    continue
            kept.append(x)
        if sum(i == r["doc_id"] for i, _ in rows) == 1:
            assert r["folio_kept_text"] == (None if r["text"] is None else "\n".join(kept)), r["doc_id"]
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).count() == len(AWKWARD)


# 8: link graph


def test_hosts_and_rules(spark):
    urls = [(1, "http://A.Example.NET/en/x?q", "net/"), (2, None, None), (3, "no scheme", None), (4, "x://example.com/de/", "example.com/de/"), (5, "x://a.org", None), (6, "x://fr.org/fr/a", "org/fr/"), (7, "x://badexample.com/de/", None), (8, "x://b.net/", "net/"), (9, "a://h/://y.net/", None), (10, "http://Example.net/en/", "example.net/en/")]
    pages = spark.createDataFrame([(i, u, None) for i, u, _ in urls], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in link_graph.filter_urls(pages, queries.URL_RULES).collect()}
    assert rows[1]["folio_host"] == "a.example.net" and rows[1]["folio_rule"] == "example.net/en/" and rows[1]["folio_verdict"] == "allow"
    for i, _, rule in urls[1:]:
        assert rows[i]["folio_rule"] == rule, i
    assert rows[9]["folio_host"] == "h" and rows[9]["folio_path"] == "/://y.net/"
    assert link_graph.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_propagation_equals_power_iteration(spark):
    rng = random.Random(1)
    hosts = [f"h{k}.com" for k in range(12)]
    pages, html = [], {}
    for k in range(60):
        h = rng.choice(hosts)
        html[k] = "".join(f"<a class=x href='{rng.choice(['http:', 'https:', ''])}//{rng.choice(hosts)}/p'>t</a>" for _ in range(rng.randrange(4))) + "<a href='/own'>o</a>"
        pages.append((k, f"http://{h}/{rng.choice('abc')}/", html[k]))
    rules = [link_graph.Rule("com", "/a/", "allow"), link_graph.Rule("com", "/b/", "block")]
    found = {r["host"]: r for r in link_graph.judge_hosts(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    links = collections.Counter()
    for _, u, h in pages:
        for dst in re.findall("//([^/]+)/p", h):
            src = u.split("/")[2]
            if src != dst:
                links[(src, dst)] += 1
    nodes = sorted({u.split("/")[2] for _, u, _ in pages} | {h for e in links for h in e})
    at = {h: k for k, h in enumerate(nodes)}
    for kind, sign, flip in (("trust", "a", False), ("distrust", "b", True)):
        seed = np.zeros(len(nodes))
        for _, u, _ in pages:
            seed[at[u.split("/")[2]]] += u.split("/")[3] == sign
        total = seed.sum()
        seed /= total
        flow = np.zeros((len(nodes), len(nodes)))
        for (a, b), n in links.items():
            flow[(at[b], at[a]) if flip else (at[a], at[b])] += n
        out = flow.sum(axis=1)
        rank = seed.copy()
        for _ in range(200):
            rank = 0.15 * seed + 0.85 * ((flow / np.where(out == 0, 1, out)[:, None]).T @ rank + rank[out == 0].sum() * seed)
        for h, r in found.items():
            assert abs(r[kind] - rank[at[h]] * total / r["pages"]) < 2e-3


def test_ranks_settle_in_pages_whatever_the_size(spark):
    """B has 50 blocked pages, A links to B and C to A; a million other blocked pages do not end the rounds early."""
    others = 1_000_000
    own = [("b.com", "/b/", 50, ""), ("a.com", "/x/", 30, "<a href='http://b.com/'>"), ("c.com", "/x/", 30, "<a href='http://a.com/'>")]
    pages = spark.createDataFrame([(f"http://{h}{p}", html) for h, p, n, html in own for _ in range(n)], "url string, html string")
    pages = pages.union(spark.range(others).select(F.lit("http://z.com/b/"), F.lit(None).cast("string")))
    found = {r["host"]: r for r in link_graph.judge_hosts(pages, [link_graph.Rule("com", "/b/", "block")]).collect()}
    # Solved at once: rows b, a, c, z; b flows to a, a to c, and c and z back to the seeds.
    seed = np.array([50, 0, 0, others]) / (50 + others)
    flow = np.zeros((4, 4))
    flow[1, 0] = flow[2, 1] = 1
    flow[:, 2] = flow[:, 3] = seed
    rank = np.linalg.solve(np.eye(4) - 0.85 * flow, 0.15 * seed) * (50 + others)
    for k, (host, n) in enumerate((("b.com", 50), ("a.com", 30), ("c.com", 30), ("z.com", others))):
        assert abs(found[host]["distrust"] - rank[k] / n) < 1e-4, host
    assert found["c.com"]["blocked"] and found["a.com"]["blocked"]


def test_hubs_change_no_verdict(spark, monkeypatch):
    """Every host with two links or pages as a hub gives the ranks and verdicts of none."""
    rng = random.Random(11)
    hosts = [f"h{k}.com" for k in range(9)]
    pages = []
    for k in range(90):
        h = rng.choice(hosts[:7])
        near = hosts[:3] if h < "h3" else hosts
        links = "".join(f"<a href='http://{rng.choice(near)}/p'>t</a>" for _ in range(rng.randrange(4)))
        pages.append((k, f"http://{h}/{rng.choice('bbbc' if h < 'h3' else 'acc')}/", links))
    pages += [pages[0], (200, None, None), (201, "no scheme", ""), (202, "http:///x", None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = [link_graph.Rule("com", "/a/", "allow"), link_graph.Rule("com", "/b/", "block")]
    ranks = lambda: {r["host"]: r for r in link_graph.judge_hosts(table, rules).collect()}
    verdicts = lambda: sorted(map(str, link_graph.filter_urls(table, rules, ["page_id"]).collect()))
    plain, judged = ranks(), verdicts()
    assert len({r["blocked"] for r in plain.values()}) == 2
    monkeypatch.setattr(link_graph, "HUB_ROWS", 1)
    monkeypatch.setattr(link_graph, "HUB_SHARE", 0.0)
    for host, r in ranks().items():
        assert abs(r["trust"] - plain[host]["trust"]) < 1e-6 and abs(r["distrust"] - plain[host]["distrust"]) < 1e-6
    assert verdicts() == judged and len(judged) == len(pages)


# 9: packing


def sequential_best_fit(lengths, capacity):
    import bisect

    bins = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(bins, n)
        bisect.insort(bins, (bins.pop(k) if k < len(bins) else capacity) - n)
    return len(bins)


def test_plan_is_sequential_best_fit():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([7, 16, 50, 300])
        lengths = [rng.randint(1, capacity if rng.random() < 0.7 else min(4, capacity)) for _ in range(rng.randrange(300))]
        counts = collections.Counter(lengths)
        plan = list(zip(*packing.best_fit_plan(counts, capacity).values(), strict=True))
        bins = collections.defaultdict(list)
        for k, (n, rank, each, first, offset) in enumerate(plan):
            end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == n else counts[n]
            for q in range(end - rank):
                bins[first + q // each].append((offset + q % each * n, n))
        assert sum(map(len, bins.values())) == len(lengths)
        for members in bins.values():
            at = 0
            for offset, n in sorted(members):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(bins) == sequential_best_fit(lengths, capacity)


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(50, "a<|endoftext|>b"), (51, "it's  \n\n 12,5 'll"), (52, " " * 3000)], "doc_id long, text string"))
    rows = packing.pack(odd, path, 256).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["id"]].append(r)
    for r in odd.where("doc_id <> 6").collect():
        ids = np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(pieces[r["doc_id"]], key=lambda p: p["piece"])
        assert [p["piece"] for p in mine] == list(range(len(mine))) and sum(p["length"] for p in mine) == len(ids)
        assert all(p["length"] == 256 for p in mine[1:])
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(members))]
        assert [o for o, _ in sorted(members)] == ends[:-1] and ends[-1] <= 256
    assert len(bins) == sequential_best_fit([r["length"] for r in rows], 256)
    assert packing.pack(empty, path).count() == 0


# 10: weak rules


def test_base_statistics(spark, docs, corpus, empty):
    word = re.compile("[^\x20\x09-\x0d]+")
    for table in (docs.select("doc_id", "text", "id"), corpus):
        for r in weak_rules.judge(table).collect():
            t = r["text"] or ""
            w = word.findall(t)
            wins = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            covered = {p for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
            lines = [x for x in t.split("\n") if word.search(x)]
            assert (r["folio_words"], r["folio_chars"], r["folio_symbols"], r["folio_dup_lines"], r["folio_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    assert weak_rules.judge(empty).count() == 0


def test_posterior_is_bayes_and_tells_bad_from_good(spark):
    found = queries.op10_weak_rules(spark, DATA.replace("0.001", "0.01")).join(spark.read.parquet(DATA.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in found) >= 0.97 * len(found)
    judged = weak_rules.judge(spark.read.parquet(f"{DATA}/documents.parquet"), keep_columns=["doc_id"]).collect()
    model = weak_rules.estimate(collections.Counter(tuple(r["folio_votes"]) for r in judged))
    for r in judged:
        assert abs(model.posterior(tuple(r["folio_votes"])) - r["folio_posterior"]) < 1e-9


# the digests of the queries


def test_query_digests(spark):
    for r in queries.op3_decontaminate(spark, DATA).limit(50).collect():
        assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() or r["n_items"] > 0
    sharded = queries.op4_histogram_sort(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert len(sharded) == len(texts)
    for r in sharded:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None


# rules that hold at every size


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.shared_dir(Session())


def test_salted_joins_keep_all_rows(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 7 else id % 50 end as k")
    facts = rows.groupBy("k").count().withColumnRenamed("count", "members").withColumn("fact", F.col("k") * 2)
    plain = rows.join(facts, "k", "left").select("id", "k", "fact")
    salted = _common.salted_join(rows, facts, "k", F.col("id"), "members", "left").select("id", "k", "fact")
    assert facts.where("members > 1000").count() == 1
    assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()


def test_hot_keys_are_few_and_right(spark):
    keyed = spark.range(20_000).selectExpr("case when id % 4 = 0 then 5 else id end as key")
    assert _common.hot_keys(keyed, "key", 1000) == [5]
    assert _common.hot_keys(keyed.limit(0), "key", 1000) == []


def test_ties_of_real_scores_and_bytes():
    """Sums of real numbers round, so counts follow one running sum over the text, as the library's do."""
    from tokenizers import Tokenizer, models

    rng = random.Random(5)
    for _ in range(50):
        vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -rng.choice([0.1, 0.3, 0.7, 2.0])) for b in range(256)]
        vocab += [(p, -rng.choice([0.1, 0.2, 0.3, 0.7, 1.1, 1.3])) for p in sorted({"".join(rng.choice("ab▁cé") for _ in range(rng.randint(1, 4))) for _ in range(14)})]
        mine, exact = token_count.UnigramCounter(vocab, True), Tokenizer(models.Unigram(vocab, 0, True))
        for _ in range(40):
            text = "".join(rng.choice("abcdé  ") for _ in range(rng.randint(1, 40)))
            assert mine.count(text)[0] == len(exact.encode(token_count.MARK + text.replace(" ", token_count.MARK)).ids), (vocab, text)


def test_counts_of_very_long_words_and_empty_tables(spark, empty):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    exact, counter = Tokenizer(models.Unigram(token_count.piece_vocabulary(path), 0, True)), token_count._counter(path)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefé漢") for _ in range(150_000))
    assert counter.count(text)[0] == len(exact.encode(token_count.MARK + text).ids)
    assert token_count.count_tokens(empty, path).count() == 0


def test_a_benchmark_in_parts_finds_the_same(spark, docs, monkeypatch):
    items = [(k, " ".join(LINE.split()[k : k + 4])) for k in range(8)] + [(None, "漢字"), (3, "one"), (3, "river bank")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = [tuple(r) for r in decontaminate.find_contamination(docs, bench, 3).select("doc_id", "text", "folio_words", "folio_spans", "folio_items").collect()]
    monkeypatch.setattr(decontaminate, "PART_BYTES", 40)
    parts = [tuple(r) for r in decontaminate.find_contamination(docs, bench, 3).select("doc_id", "text", "folio_words", "folio_spans", "folio_items").collect()]
    assert sorted(map(str, whole)) == sorted(map(str, parts))
    assert any(r[3] for r in whole)


def test_scores_are_log_density_differences(spark, corpus):
    """Each score against densities written out with inverses and determinants."""
    small = DATA
    labels = spark.read.parquet(f"{small}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    x = {i: np.array(quality.statistics(t.encode() if t is not None else None)) for i, t in texts.items()}
    of = [np.array([x[i] for i, y in marks.items() if y == c]) for c in (0, 1)]
    scatter = [(a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) for a in of]
    pooled = np.diag(np.diag(sum(scatter)) / len(marks) + 1e-6)
    cov = [(1 - quality.SHRINKAGE) * s / len(a) + quality.SHRINKAGE * pooled for s, a in zip(scatter, of, strict=True)]

    def density(c, v):
        d = v - of[c].mean(axis=0)
        return -0.5 * d @ np.linalg.inv(cov[c]) @ d - 0.5 * np.linalg.slogdet(cov[c])[1]

    found = quality.score_quality(corpus, labels).collect()
    assert len(found) == len(texts)
    for r in found:
        odds = (density(1, x[r["id"]]) - density(0, x[r["id"]])) / quality.TEMPERATURE + np.log(len(of[1]) / len(of[0]))
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-6
        assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    kept = {r["doc_id"] for r in quality.keep_good(corpus, labels).collect()}
    assert kept == {r["id"] for r in found if r["predicted"]}


@pytest.mark.parametrize("weight", [None, 60])
def test_ngram_join_deals_hot_keys(spark, monkeypatch, weight):
    """With every key taken for hot, members meet in blocks only and the result is the same."""
    monkeypatch.setattr(ngram_join, "HOT_MEMBERS", 1)
    if weight:
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 2)
        monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", weight)
    rng, rows = random.Random(11), []
    for base in range(5):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        for copy in range(5):
            rows.append((base * 10 + copy, " ".join(w if rng.random() > copy * 0.01 else f"z{rng.randrange(9)}" for w in words)))
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=80).collect()
    assert sorted((str(r["id"]), r["n_grams"], str(r["component"]), r["links"]) for r in found) == brute_components(rows, 3, 80)


def test_partial_overlaps_sum_to_the_overlap():
    rng = np.random.default_rng(4)
    for sets_of in (3, 40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64) << np.uint64(58)) for _ in range(sets_of)]
        group = np.sort(rng.integers(0, 2, sets_of))
        owner = np.repeat(np.arange(sets_of), [len(s) for s in sets])
        i, j, shared = ngram_join.partial_overlaps(np.concatenate(sets), owner, group)
        found = dict(zip(zip(i.tolist(), j.tolist(), strict=True), shared.tolist(), strict=True))
        wanted = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(sets_of) for b in range(a + 1, sets_of) if group[a] == group[b]}
        assert found == {k: v for k, v in wanted.items() if v}


def test_line_dedup_deals_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_MEMBERS", 1)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 3)
    rng = random.Random(6)
    bases = ["".join(rng.choice("abcdé ") for _ in range(30)) for _ in range(8)]
    rows = [(k, "\n".join(mutated(rng, rng.choice(bases), rng.randint(0, 3)) for _ in range(3))) for k in range(25)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    hot = sorted((r["doc_id"], r["folio_kept_text"], r["folio_removed"]) for r in line_dedup.dedup_lines(table).collect())
    monkeypatch.undo()
    assert hot == sorted((r["doc_id"], r["folio_kept_text"], r["folio_removed"]) for r in line_dedup.dedup_lines(table).collect())
    assert any(r[2] for r in hot)


def test_columns_of_the_added_names_give_way(spark):
    table = spark.createDataFrame([(1, LINE + "\n" + LINE, "x", [9])], "doc_id long, text string, folio_kept_text string, folio_removed array<int>")
    row = line_dedup.dedup_lines(table).first()
    assert row["folio_kept_text"] == LINE and row["folio_removed"] == [1]


def test_verdicts_on_a_graph_with_links(spark):
    """``filter_urls`` against ranks by repeated multiplication, with repeated pages, clashing columns and a long page."""
    rng = random.Random(9)
    hosts = [f"h{k}.com" for k in range(9)]
    pages = []
    for k in range(80):
        h = rng.choice(hosts)
        # Low hosts are blocked and link one another, high ones are allowed, those between link either.
        near = hosts[:3] if h < "h3" else hosts[6:] if h > "h5" else hosts
        links = "".join(f"<a href='http://{rng.choice(near)}/p'>t</a>" for _ in range(rng.randrange(3)))
        pages.append((k, f"http://{h}/{rng.choice('bbc' if h < 'h3' else 'aac' if h > 'h5' else 'cd')}/", ("x" * 100_000 if k == 3 else "") + links))
    pages += [pages[0], pages[0], (200, None, None), (201, "no scheme", "<a href='http://h1.com/'>")]
    rules = [link_graph.Rule("com", "/a/", "allow"), link_graph.Rule("com", "/b/", "block")]
    table = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, folio_open int, rank int")
    found = link_graph.filter_urls(table, rules, ["page_id", "url"]).collect()
    assert len(found) == len(pages)
    at = {h: k for k, h in enumerate(hosts)}
    count, seed = np.zeros(len(hosts)), {"a": np.zeros(len(hosts)), "b": np.zeros(len(hosts))}
    flow = np.zeros((len(hosts), len(hosts)))
    for _, u, h in pages:
        if u and "://" in u:
            src = u.split("/")[2]
            count[at[src]] += 1
            if u.split("/")[3] in seed:
                seed[u.split("/")[3]][at[src]] += 1
            for dst in re.findall("http://([^/]+)/p", h):
                flow[at[src], at[dst]] += src != dst

    def ranks(start, edges):
        total, out = start.sum(), edges.sum(axis=1)
        s = start / total
        r = s.copy()
        for _ in range(400):
            r = 0.15 * s + 0.85 * ((edges / np.where(out == 0, 1, out)[:, None]).T @ r + r[out == 0].sum() * s)
        return r * total / np.maximum(count, 1)

    trust, distrust = ranks(seed["a"], flow), ranks(seed["b"], flow.T)
    blocked = {h for h in hosts if distrust[at[h]] > 0.5 and distrust[at[h]] > trust[at[h]]}
    assert 0 < len(blocked) < len(hosts)
    for r in found:
        path = (r["url"] or "").split("/")
        own = {"a": "allow", "b": "block"}.get(path[3] if len(path) > 3 else "")
        assert r["folio_verdict"] == (own or ("block" if r["folio_host"] in blocked else "allow")), r


def test_quick_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact, rng = Tokenizer.from_file(path), random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "漢", "😀", "'s", "12", "!", "\t", "\x00", "<|endoftext|>", " ", "Ab"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert packing.encode(text, path).tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_packing_of_repeated_and_unnamed_rows(spark):
    rows = [(6, "one two"), (6, "one two"), (None, "alone"), (None, None), (None, "alone"), (7, "w " * 700)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), 256).collect()
    pieces = collections.Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    assert sum(n for k, n in pieces.items() if k[0] == 6) == 2 and sum(n for k, n in pieces.items() if k[0] is None) == 3
    assert sorted(pieces[k] for k in pieces if k[0] is None) == [1, 2]
    for _, members in itertools.groupby(sorted(found, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in members:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256


def test_rotation_of_odd_tables(spark, empty):
    schema = "conv_id long, turn long, role string, text string, block int, speaker string"
    turns = [(1, None, "ann", "x" * 50_000, 1, "s"), (1, None, "ann", "x" * 50_000, 1, "s"), (1, 3, "bob", "", 1, "s")]
    rows = chat_rotation.rotate_perspectives(spark.createDataFrame(turns, schema)).collect()
    for who in ("ann", "bob"):
        view = sorted((r for r in rows if r["perspective"] == who), key=lambda r: r["position"])
        whole = "".join(r["rendered"] for r in view)
        assert [r["position"] for r in view] == [0, 1, 2] and all(whole[r["char_start"] :].startswith(r["rendered"]) for r in view)
    assert chat_rotation.rotate_perspectives(spark.createDataFrame([], schema)).count() == 0


def test_shard_columns_are_as_the_contract_says(spark, duck):
    """Size, checksum and gapless slots by SQL over the query's own shards."""
    found = queries.op4_histogram_sort(spark, DATA).toPandas()
    duck.register("placed", found)
    wrong = duck.execute(
        "SELECT count(*) FROM placed p JOIN documents d USING (doc_id) WHERE p.size <> coalesce(octet_length(encode(d.text)), 0) + 8 OR p.shard NOT BETWEEN 0 AND 23 OR p.law <> 'bytes'"
        " UNION ALL SELECT count(*) FROM (SELECT shard, count(*) AS n, max(slot) + 1 AS top, count(DISTINCT slot) AS k, min(slot) AS low FROM placed GROUP BY shard) WHERE n <> top OR n <> k OR low <> 0"
    ).fetchall()
    assert wrong == [(0,), (0,)] and len(found) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_expectation_maximisation_by_rows():
    """The estimate over counted patterns equals one over single rows, written out."""
    rng = random.Random(2)
    rows = [tuple(rng.choice((-1, 0, 1, 1)) for _ in range(3)) for _ in range(300)]
    model = weak_rules.estimate(collections.Counter(rows), rounds=5, tolerance=0)
    votes, prior, n = [weak_rules.BELIEF] * 3, 0.9, len(rows)
    for _ in range(5):
        post = []
        for row in rows:
            g, b = prior, 1 - prior
            for (bad, good), v in zip(votes, row, strict=True):
                g, b = g * good[v], b * bad[v]
            post.append(g / (g + b))
        new = []
        for r in range(3):
            both = []
            for belief, weight in zip(weak_rules.BELIEF, ([1 - p for p in post], post), strict=True):
                table = [weak_rules.BELIEF_WEIGHT * n * x for x in belief]
                for row, w in zip(rows, weight, strict=True):
                    table[row[r]] += w
                both.append([t / sum(table) for t in table])
            if both[1][0] > weak_rules.FALSE_ALARMS:
                rest = 1 - both[1][0]
                both[1] = [weak_rules.FALSE_ALARMS, *(t * (1 - weak_rules.FALSE_ALARMS) / rest for t in both[1][1:])]
            new.append((tuple(both[0]), tuple(both[1])))
        votes, prior = new, (sum(post) + 1) / (n + 2)
    assert abs(model.prior - prior) < 1e-9
    assert np.allclose(np.array(model.votes), np.array(votes))
