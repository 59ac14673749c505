import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from newsquery.llm import decontaminate, language_id, pii
from tests.llm.test_jaccard_join import brute

EN = "the river and window of garden with that table for paper this have from mountain".split()
DE = "der und die das fenster mit garten über nicht straße auch wir schön häuser für".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(6)
    folder = tmp_path_factory.mktemp("tables")
    prose = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "er", f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}"]) for _ in range(n))
    items = [(i, prose(EN, 40)) for i in range(12)]
    docs = [(i, prose(EN if i % 3 else DE, rng.choice([30, 120, 400])), "en" if i % 3 else "de", f"s{i % 4}") for i in range(90)]
    docs += [(100 + k, docs[k][1], docs[k][2], "copy") for k in range(5)]
    docs += [(90 + k, docs[k][1] + " more here", docs[k][2], "near") for k in range(20, 24)]
    docs += [(120 + k, docs[30 + k][1] + " " + items[k][1] + " " + docs[40 + k][1], "en", "leak") for k in range(3)]
    docs += [(130 + k, prose(EN, 60) + " " + " ".join(w for j, w in enumerate(items[5 + k][1].split()) if j % 9), "en", "edited") for k in range(3)]
    docs += [(140, "write to a.smith77@mail.example.com or 4111111111111111 in the garden " + prose(EN, 60), "en", "pii"), (141, "4111111111111111 again " + prose(EN, 70), "en", "pii")]
    docs += [(150, None, "en", "x"), (151, "", None, "x"), (152, "12345 678", "en", "x"), (153, "漢字仮名交じり文" * 20, "en", "x"), (60, docs[60][1], docs[60][2], docs[60][3])]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def test_each_stage_against_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"]: r["text"] for r in out["language_id"]}
    assert {r[0] for r in rows} - set(kept) == {150, 151, 152, 153}
    groups = brute(kept, 5, 80)
    got, want = {r["doc_id"] for r in out["jaccard_join"]}, {i for i, (_, c) in groups.items() if c == i}
    assert (got - want, want - got) == (set(), set())
    assert len(out["jaccard_join"]) == len(got)
    assert got.isdisjoint({100, 101, 102, 103, 104})
    clean = {r["doc_id"] for r in out["decontamination"]}
    assert {r["doc_id"] for r in out["jaccard_join"]} - clean == {120, 121, 122, 130, 131, 132}
    after = {r["doc_id"]: r["text"] for r in out["pii_pseudonyms"]}
    assert set(after) == clean
    assert "a.smith77" not in after[140] and "4111111111111111" not in after[140]
    assert after[140].split()[4] == after[141].split()[0]
    assert all(after[i] == t for i, t in kept.items() if i in after and i < 100)
    packed = out["best_fit_packing"]
    assert {r["doc_id"] for r in packed} == clean
    fills = {}
    for r in packed:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in fills.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= 1024


def test_run_equals_the_stages(spark, tables):
    folder = tables[0]
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, spark.read.parquet(f"{folder}/best_fit_packing").collect()))


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_contaminated_against_brute_force(spark, tables):
    folder, rows, items = tables
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    want = {}
    for i, text in {(r[0], r[1]) for r in rows}:
        for item, t in items:
            score = smith_waterman(t.split(), (text or "").split()) / (2 * len(t.split()))
            if score >= 0.5:
                want[i, item] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got.keys() == want.keys() and len(want) == 6
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, block_words=150).collect()}
    assert blocks == want.keys()
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == [] == decontaminate.contaminated(docs.limit(0), bench).collect()


def test_rows_without_an_id_are_judged_too(spark, tables):
    folder, rows, items = tables
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    own = [(None, items[0][1], 1), (None, rows[3][1], 2), (1, items[1][1], 3), (1, rows[4][1], 4), (2, None, 5), (3, "", 6), (4, "x " * 200000 + items[2][1], 7)]
    docs = spark.createDataFrame(own, "doc_id long, text string, item_id int")
    for block_words in (10**6, 100):
        assert sorted(r["item_id"] for r in decontaminate.uncontaminated(docs, bench, block_words=block_words).collect()) == [2, 4, 5, 6]
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, block_words=block_words).collect()} == {(None, 0), (1, 1), (4, 2)}
    assert decontaminate.uncontaminated(docs, bench.limit(0)).count() == 7 and decontaminate.uncontaminated(docs.limit(0), bench).count() == 0


def test_parts_of_a_passage_that_many_hold(spark, tables):
    """Half of a passage in hundreds of copies, whichever half, is found."""
    words = tables[2][3][1].split()
    texts = [" ".join(words)] * 300 + [" ".join(words[20:]), " ".join(words[:20]), " ".join(words[10:30]), "nothing of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == set(range(303))


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_null_and_repeated_ids_through_the_pipeline(spark, tables, tmp_path):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame([(None, items[0][1], "en", "s", 1), (None, rows[1][1] + " and more of it", "en", "s", 1), (None, None, None, None, None)], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).filter("doc_id is null").collect()
    assert len(out) == 1 and out[0]["piece"] == 0


def test_language_of_held_out_texts(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit(docs), keep=("lang",)).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows if r[0] < 120)
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True) for i in (150, 151, 152))
    assert got[153]["rejected"]
    nothing = docs.limit(0)
    assert language_id.fit(nothing) is None and language_id.identify(nothing, None).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_pii_key_is_not_a_secret_of_the_library():
    assert corpus_pipeline.PII_KEY == "newsquery-demonstration-key" and pii.ROUNDS >= 8
