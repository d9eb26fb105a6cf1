"""The pipeline against a plain version of each of its stages."""

import random
from collections import Counter

import pytest

from netquarry.llm import mixing, quality
from netquarry.llm.token_parquet import WordEncoder, tokenizer_file

from .test_dedup import brute_near
from .test_texts import brute_leaks

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WIDE = "doc_id long, text string, source string, lang string"


def documents():
    """Good prose, shouted rubbish, near and exact copies, benchmark passages, nulls, empty and very long texts, repeated and null doc_ids."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shout = lambda n: " ".join(word().upper() + "!!" for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate((30, 14, 40))]
    rows, labels = [], []
    for k in range(140):
        bad = k % 4 == 0
        rows.append((k, (shout if bad else prose)(rng.randint(20, 70)), rng.choice(["a", "b", None])))
        labels.append((k, int(not bad), 0))
    for k in range(140, 150):
        copied = rows[rng.choice([1, 2, 3, 5, 6, 7])][1].split()
        rows.append((k, " ".join(copied if k % 2 else copied[:-1] + [word()]), "a"))
    for k in range(150, 156):
        passage = items[k % 3][1].split()
        passage[3] = word()
        rows.append((k, f"{prose(12)} {' '.join(passage)} {prose(9)}", "b"))
    rows += [(200, None, "a"), (201, "", "b"), (202, prose(30_000), "b"), (203, prose(40), "c"), (203, rows[1][1], "c"), (None, prose(35), "a")]
    return rows, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows, items, labels = documents()
    spark.createDataFrame([(*r, "en") for r in rows], WIDE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_equals_its_plain_version(spark, folder):
    rows, items, _ = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [r for r in rows if model.score((r[1] or "").encode()) >= quality.THRESHOLD]
    lost = {r[0] for r in rows} - {r[0] for r in kept}
    assert lost & set(range(0, 140, 4)) and not lost & {k for k in range(140) if k % 4}
    assert Counter(r[:3] for r in map(tuple, corpus_pipeline.quality(spark, docs, folder).collect())) == Counter(kept)

    named = [(k, t) for k, (_, t, _) in enumerate(kept)]  # by place: the least of a group stays, by doc_id and then by place
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))
    ranks = {k: n for n, k in enumerate(order)}
    first = {k for k, _, _, stays in brute_near(sorted((ranks[k], t) for k, t in named), 5, 80) if stays}
    unique = [kept[k] for k in range(len(kept)) if ranks[k] in first]
    table = spark.createDataFrame([(*r, "en") for r in kept], WIDE)
    assert Counter(r[:3] for r in map(tuple, corpus_pipeline.near_dedup(spark, table, folder).collect())) == Counter(unique)

    leaked = {i for i, *_ in brute_leaks([r[:2] for r in unique], items)}
    clean = [r for r in unique if r[0] not in leaked]
    assert leaked >= set(range(150, 156)) & {r[0] for r in unique}
    table = spark.createDataFrame([(*r, "en") for r in unique], WIDE)
    assert Counter(r[:3] for r in map(tuple, corpus_pipeline.leaks(spark, table, folder).collect())) == Counter(clean)

    table = spark.createDataFrame([(*r, "en") for r in clean], WIDE)
    copies = Counter()
    for r in mixing.mix(table).collect():
        copies[r.doc_id] += r.copies
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix(spark, table, folder).collect())
    assert mixed == Counter({k: n for k, n in copies.items() if n})

    encoder, want = WordEncoder(tokenizer_file()), []
    for i, t, _ in clean:
        if Counter(r[0] for r in clean)[i] == 1:
            want += [(i, len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)] * copies[i]
    got = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()]
    assert Counter(got) == Counter(want)


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    rows, *_ = documents()
    wide = "doc_id long, text string, source string, TEXT string, _row string, _copies string, h string"
    for some in ([], rows[:12]):
        docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in some], wide)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns or name == "tokens"
            assert len(out.collect()) <= 2 * len(some)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
