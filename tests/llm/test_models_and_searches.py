import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanloom.llm import decontaminate as D
from loanloom.llm import language, licences, shards, toxicity
from tests.llm.conftest import prose


def edits_within(pattern, text):
    """Least edit distance of the pattern to a stretch of the text, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for word in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != word), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        pattern = [rng.randrange(6) for _ in range(rng.randrange(1, 90))]
        text = [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        assert D.edit_distance_within(pattern, text)[0] == edits_within(pattern, text)


def test_edited_items_are_found_and_nothing_else(documents, spark):
    rng = random.Random(3)
    items = {i: prose(rng, rng.randrange(14, 60), 900) for i in range(60)}
    items[90], items[91], items[92] = None, "", "too short"
    texts, want, total = {}, set(), 0
    for i in range(240):
        words = prose(rng, rng.randrange(0, 120), 900).split()
        if i % 2:
            item = rng.randrange(60)
            copy = items[item].split()
            for _ in range(rng.randrange(0, D.most_edits(len(copy)) + 1)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randrange(2)] = rng.choice([[], [f"x{i}"], [copy[at], "y"]])
            words[len(words) // 2:len(words) // 2] = copy
        texts[i] = " ".join(words).replace("w1", "W-1").replace(" w2", ", w2")
    plain = {i: t.lower().replace("-", "").replace(",", "").split() for i, t in texts.items()}
    for i, words in plain.items():
        for item, text in items.items():
            size = len((text or "").split())
            if size >= 5 and edits_within(text.split(), words) <= D.most_edits(size):
                want.add((i, item))
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = D.leaks(documents(texts), benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 100
    for r in rows:
        assert r.distance == edits_within(items[r.item_id].split(), plain[r.doc_id])
    kept = D.drop_leaks(documents(texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {i for i, _ in got}


def test_leaks_of_odd_rows(odd, none, spark, monkeypatch):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(odd, empty).count() == 0 and D.drop_leaks(odd, empty).count() == odd.count()
    text = odd.where("doc_id = 8").first().text
    items = spark.createDataFrame([(1, text), (1, text), (None, "é" * 80), (3, None)], "item_id long, text string")
    whole = sorted(map(tuple, D.leaks(odd, items).collect()), key=repr)
    assert {(r[0], r[1]) for r in whole} >= {(8, 1), (9, 1), (None, 1)}
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, D.leaks(odd, items).collect()), key=repr) == whole
    assert D.drop_leaks(odd, items).columns == odd.columns
    assert D.leaks(none, items).count() == 0


def syllables(rng, kind, n):
    stock = {"aa": "ka lo mi nu ra".split(), "bb": "sch tür eng ost ix".split(), "cc": "пра во на ст ом".split()}[kind]
    return " ".join("".join(rng.choice(stock) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages_of_held_out_documents(spark):
    rng = random.Random(2)
    rows = [(i, syllables(rng, kind, rng.randrange(5, 400)), kind) for i, kind in enumerate(["aa", "bb", "cc"] * 100)]
    rows += [(1000, None, "aa"), (1001, "12 34 !", "bb"), (1002, "", None), (1003, syllables(rng, "cc", 9000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language.fit(docs.where(~language.held_out(F.col("doc_id"))), sample=60)
    assert network.labels == ["aa", "bb", "cc"]
    found = {r.doc_id: r for r in language.identify(docs, network).withColumn("held", language.held_out(F.col("doc_id"))).collect()}
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found.values())
    held = [r for r in found.values() if r.held and r.lang and r.text and r.doc_id < 1000]
    assert len(held) > 30 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    network = language.Network.fresh(["a", "b", "c"])
    windows, target = rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint8), rng.integers(0, 3, 6)
    for p in network.parameters():
        p += rng.normal(0, 0.02, p.shape).astype(np.float32)
    loss = lambda: -np.log(network.probabilities(windows)[np.arange(6), target]).mean()
    for p, g in zip(network.parameters(), network.gradients(windows, target)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.15, abs=2e-3)


def test_language_without_labels_and_odd_rows(odd, none):
    assert language.fit(none) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    network = language.fit(odd)
    found = language.identify(odd, network)
    assert found.count() == odd.count() and network.labels == ["en"]
    assert {r.lang_pred for r in found.where("text is null or text = '' or doc_id = 11").collect()} == {"und"}
    assert language.identify(none, network).count() == 0


def test_toxic_documents_of_no_training_row(documents, spark):
    rng, bad = random.Random(6), "vile foul grim".split()
    rows = []
    for i in range(900):
        words, grade = prose(rng, rng.randrange(20, 200)).split(), rng.choice([0, 0, 0, 1, 2])
        for _ in range(3 * grade):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + ",")
        rows.append((i, " ".join(words), grade if i < 700 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(docs)
    assert list(model.thresholds) == sorted(model.thresholds)
    found = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    rest = [(found[i], t) for i, t, g in rows if g is None]
    assert np.mean([r.toxic == any(b.upper() in t for b in bad) for r, t in rest]) > 0.97
    assert all(0 <= r.expected_severity <= 2 and (r.p_toxic >= 0.5) == r.toxic for r, _ in rest)


def test_toxicity_of_odd_rows(odd, none):
    assert toxicity.fit(odd.withColumn("grade", F.lit(None).cast("int"))) is None
    assert {r.toxic for r in toxicity.predict(odd, None).collect()} == {None}
    model = toxicity.fit(odd.withColumn("grade", F.when(F.col("doc_id") > 8, 1).otherwise(0)))
    assert toxicity.predict(odd, model).count() == odd.count() and toxicity.predict(none, model).count() == 0


def test_toxicity_holds_a_few_texts_at_a_time():
    """A batch of 16 MB, as one of 8,000 texts of a page is: not arrays over all its bytes at once."""
    texts = [f"Word{i} " * 250 for i in range(8000)] + [None, ""]
    n, size = len(texts), sum(len(t or "") for t in texts)
    batch = pa.record_batch({"doc_id": pa.array(range(n)), "text": pa.array(texts, pa.string()), "draw": pa.array(range(n)),
                             "grade": pa.array([0] * n, pa.int32())})
    tracemalloc.start()
    rows = [r for part in toxicity._features(iter([batch])) for r in part.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 16e6 and peak < 4 * size
    assert [r["draw"] for r in rows] == list(range(n)) and [len(r["places"]) for r in rows] == [4] * 8000 + [0, 0]
    places = np.frombuffer(rows[7]["places"], np.int32)
    model = toxicity.Model(np.array([0.5]), places.astype(np.int64), np.array([1.0]))
    found = [r for part in toxicity._predictions(iter([batch]), model) for r in part.to_pylist()]
    assert [r["doc_id"] for r in found] == list(range(n)) and [r["doc_id"] for r in found if r["toxic"] != found[0]["toxic"]] == [7]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    order = shards.Feistel(n, 9)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order.numbers(slots) == np.arange(n)).all()
    assert n < 100 or (slots != shards.Feistel(n, 10).slots(np.arange(n))).any()


@pytest.mark.parametrize("stream", [64, 1 << 22])
def test_shards_hold_every_text(odd, spark, stream, monkeypatch):
    docs = odd.where("doc_id is null or doc_id <> 7")
    frame, folder = shards.write_shards(docs, length=64, shard_rows=50, key=3)
    rows = frame.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all((r.shard, r.place) == divmod(r.slot, 50) for r in rows)
    again = np.concatenate(list(shards.read_slots(folder, 0, len(rows), 64, 50)))
    assert np.array_equal(np.concatenate(list(shards.read_slots(folder, 37, 60, 64, 50))), again[37 * 64:97 * 64])
    order = shards.Feistel(len(rows), 3)
    stream = again.reshape(-1, 64)[order.slots(np.arange(len(rows)))].tobytes()
    want = sorted((r.text or "").encode() for r in docs.collect())
    got = sorted(stream.split(b"\xff"))
    assert [t for t in got if t] == [t for t in want if t]
    assert {i for r in rows for i in r.doc_ids} == {r.doc_id for r in docs.collect()}
    # A second run over the same folder leaves the shards alone and gives the same rows.
    assert sorted(map(repr, shards.write_shards(docs, folder, 64, 50, 3)[0].collect())) == sorted(map(repr, rows))


def test_shards_of_another_key_are_written_anew(documents):
    docs = documents({i: f"text {i} of shards " * 9 for i in range(40)}, parts=1)
    first, folder = shards.write_shards(docs, length=64, shard_rows=8, key=3)
    first.collect()
    n = len(shards.write_shards(docs, folder, 64, 8, 4)[0].collect())
    fresh, other = shards.write_shards(docs, length=64, shard_rows=8, key=4)
    assert len(fresh.collect()) == n
    held = [np.concatenate(list(shards.read_slots(f, 0, n, 64, 8))) for f in (folder, other)]
    assert np.array_equal(*held)


def test_shards_of_a_vocabulary(documents, tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([bytes([b]) for b in range(256)] + [b"th", b"the"])))
    encoder = shards.Ranks(str(path), r"\S+|\s+", 258)
    frame, folder = shards.write_shards(documents({1: "the then", 2: None}), length=4, shard_rows=2, encoder=encoder)
    n = len(frame.collect())
    ids = np.concatenate(list(shards.read_slots(folder, 0, n, 4, 2, "<u2")))
    assert (ids == 257).sum() == 2 and (ids == 256).sum() == 0


def test_no_shards_of_nothing(none):
    assert shards.write_shards(none)[0].count() == 0


def test_licences(documents, odd, none):
    apache = "\n".join(licences.RULES[5][1])
    texts = {
        1: "Some words\nReleased under the MIT License.\nMore", 2: "released   under the mit\nlicense!", 3: None, 4: "",
        5: "We say it is Released under the MIT License.", 6: "Released under the MIT License of old.",
        7: "Copyright me.\n" + apache.replace("you may not", "you\n   may not") + "\nEnd", 8: "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.",
        9: "See the License for the specific language governing permissions and limitations under the License."}
    got = {}
    for r in licences.licences(documents(texts)).collect():
        got.setdefault(r.doc_id, []).append(r.licence)
        assert 0 <= r.start < r.end <= len(texts[r.doc_id])
    assert got == {1: ["MIT"], 2: ["MIT"], 7: ["Apache-2.0"], 8: ["CC-BY-4.0", "CC-BY-NC-4.0"]}
    assert licences.licences(odd).count() == licences.licences(none).count() == 0


def test_longest_rule_wins(documents):
    bsd = {name: "\n".join(s) for name, s in licences.RULES if name.startswith("BSD")}
    rows = licences.licences(documents({1: bsd["BSD-3-Clause"], 2: bsd["BSD-2-Clause"]})).collect()
    assert {r.doc_id: r.licence for r in rows} == {1: "BSD-3-Clause", 2: "BSD-2-Clause"}


def test_reserved_rights(documents):
    bsd = next(s for name, s in licences.RULES if name == "BSD-2-Clause")
    texts = {
        1: "Some words.\nAll rights reserved.\nMore", 2: "Copyright (c) 2020 Acme\nAll Rights Reserved", 3: "© 2020 Acme, all rights reserved.",
        4: "He said that all rights reserved.", 5: "All rights reserved to guests.", 6: "Copyright 2020 Acme.\nAll rights reserved.\n" + "\n".join(bsd),
        7: "All rights reserved.\nReleased under the MIT License."}
    got = {}
    for r in licences.licences(documents(texts)).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append(r.licence)
    own = ["proprietary"]
    assert got == {1: own, 2: own, 3: own, 6: ["BSD-2-Clause"], 7: ["proprietary", "MIT"]}


def test_every_licence_line_of_the_sample_gives_a_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    lines = docs.selectExpr("explode(split(text, '\\n')) AS line").where("line RLIKE '(?i)licen[cs]e|rights reserved|copyright'")
    kinds = {i: r.line for i, r in enumerate(lines.distinct().collect())}
    assert len(kinds) == 5
    found = {r.doc_id for r in licences.licences(spark.createDataFrame(list(kinds.items()), "doc_id long, text string")).collect()}
    assert [kinds[i] for i in kinds if i not in found] == []
