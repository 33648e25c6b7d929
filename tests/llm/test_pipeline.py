"""The pipeline's stages, each on what the stage before it kept."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.keep(stage(spark, docs, SF), name)
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == first.columns
            assert docs.where("text is not null and n_chars <> length(text)").count() == 0 or name == "toxicity"
    assert kept["toxicity"] >= kept["line_dedup"] == kept["toxicity"] >= kept["near_dedup"] == kept["secrets"] > 0
    assert {r[0] for r in before.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), name)
    assert docs.count() == 0


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def planted(spark):
    """Rows with null, repeated and clashing ids: (id, text)."""
    shared = words(1, 120)
    rows = {
        "first": (1, shared),
        "copy under another id": (2, shared),
        "own text under the copy's id": (2, words(2, 100)),
        "near copy without an id": (None, shared.replace(shared.split()[50], "zuzu", 1)),
        "secret without an id": (None, f"{words(3, 60)} token = only_mine_77 {words(4, 60)}"),
        "equal row": (5, words(5, 90)),
        "equal row again": (5, words(5, 90)),
        "innocent under a taken id": (6, words(6, 80)),
        "secret under a taken id": (6, f"{words(7, 70)} password: ne_99xyz {words(8, 5)}"),
        "null text": (7, None),
        "empty text": (8, ""),
    }
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    made = [(i, t, "en", f"s{n}", None if t is None else len(t)) for n, (i, t) in enumerate(rows.values())]
    return rows, spark.createDataFrame(made, shape).coalesce(1)


def left(docs):
    return sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()), key=repr)


def wanted(rows, *names):
    return sorted(((i, t, None if t is None else len(t)) for i, t in (rows[n] for n in names)), key=repr)


def test_near_copies_by_row(spark):
    rows, docs = planted(spark)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    stays = [n for n in rows if n not in ("copy under another id", "near copy without an id", "equal row again")]
    assert left(got) == wanted(rows, *stays)


def test_secrets_by_row(spark):
    rows, docs = planted(spark)
    got = left(corpus_pipeline.hide_secrets(spark, docs, SF))
    hidden = {n: (i, t and t.replace("token = only_mine_77", "[secret]").replace("password: ne_99xyz", "[secret]")) for n, (i, t) in rows.items()}
    assert got == wanted(hidden, *rows)
    assert sum("[secret]" in (t or "") for _, t, _ in got) == 2


def test_lines_by_row(spark):
    rows, docs = planted(spark)
    got = left(corpus_pipeline.drop_lines(spark, docs, SF))
    # A line is a whole text here: one of each class stays, the others are emptied.
    assert len(got) == len(rows)
    texts = [t for _, t, _ in got]
    near = {rows["first"][1], rows["near copy without an id"][1]}
    assert sum(t in near for t in texts) == 1 and texts.count(rows["equal row"][1]) == 1
    for name in ("own text under the copy's id", "secret without an id", "innocent under a taken id", "secret under a taken id"):
        assert rows[name][1] in texts
    assert texts.count(None) == 1 and all(n == len(t) for _, t, n in got if t is not None)


def test_packing_keeps_every_row(spark):
    rows, docs = planted(spark)
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert sum(p["start"] == 0 for p in pieces) == len(rows)
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    """On documents the model has not learnt from."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stays = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    toxic, clean = [i for i in held if labels[i]], [i for i in held if not labels[i]]
    assert sum(i not in stays for i in toxic) / len(toxic) > 0.6
    assert sum(i in stays for i in clean) / len(clean) > 0.97


def test_toxicity_query_on_the_held_out_fold(spark):
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = contract.queries()["op8_toxicity"](spark, sf).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    high = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1]
    low = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 0]
    auc = sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low))
    assert auc > 0.95


def test_offsets_beside_letters_that_grow(spark):
    from accordant.llm import toxicity

    text = "İstanbul is fine vile word"
    chance = toxicity.np.array([0.0, 0.0, 0.0, 0.9, 0.0])
    assert len(toxicity.tokens(text)) == 5
    (span,) = toxicity.spans(text, chance, 0.5)
    assert text[span["start"] : span["end"]] == "vile"
