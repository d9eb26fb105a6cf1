import gzip
import hashlib
import io
import itertools
import math
import random
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import chat, mixing, quality, token_parquet, warc
from netquarry.llm import decontaminate as decontaminate_module
from netquarry.llm.decontaminate import SIMILARITY, decontaminate, find_leaks, masks_of
from netquarry.llm.token_parquet import WordEncoder, digests, read_tokens, tokenizer_file, write_tokens
from netquarry.llm.warc import archive, read_records, write_monoliths, normalise

TOKENIZER = tokenizer_file()


def table(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, source, "x", "y") for i, t in rows], "doc_id long, text string, source string, ids string, SOURCE string")


def test_encoder_equals_library():
    rng = random.Random(3)
    parts = ["'s", "'", "a", "É", "é", "ß", "İ", "Σ", "0", "5", "²", "ª", "µ", "!", "#", "<", "<|endoftext|>", "\x85", "\xa0", "\x1c", "\r", "é", "K", "ŉ", "😀", " ", "\n", "\t", "'LL", "It's", "½"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + ["", None, "word " * 5000]
    made = WordEncoder(TOKENIZER)
    flat, sizes = made.encode(texts)
    ends = np.cumsum(sizes)
    for t, a, n in zip(texts, ends - sizes, sizes, strict=True):
        assert flat[a : a + n].tolist() == [*made.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_encoder_keeps_words_in_use(monkeypatch):
    monkeypatch.setattr(token_parquet, "CACHE_WORDS", 40)
    made, met = WordEncoder(TOKENIZER), []
    make = made.known.make
    made.known.make = lambda word: met.append(word) or make(word)
    texts = [f"The same words, as ever: É'll {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]} <{k}>" for k in range(600)]
    flat, sizes = made.encode(texts)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert flat[a:b].tolist() == [*made.tokenizer.encode(t, add_special_tokens=False).ids, 1]
    assert met.count("same") == met.count("words,") == met.count("é'll") == 1 and met.count("<0>") == 1
    assert len(made.known) + len(made.known.before) < 100


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, tmp_path, encoding):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, "", "some words " * rng.randint(1, 40), f"Übung {k}"])) for k in rng.sample(range(1000), 90)] + [(5000, "again"), (5000, "again"), (5000, "other"), (-3, "x y " * 30000), (None, "no id"), (None, "")]
    folder = f"file://{tmp_path}/tokens"
    manifest = write_tokens(table(spark, rows), folder, TOKENIZER, encoding, group_tokens=200)
    got = digests(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    starts = {(r.doc_id, r.start) for r in got}
    for low, high in ((100, 300), (0, 39), (-10, 5000), (6000, 7000)):
        some = read_tokens(manifest, (low, high)).collect()
        assert sorted(r.doc_id for r in some) == sorted(i for i, _ in rows if i is not None and low <= i <= high) and all(r.ids[-1] == 1 and len(r.ids) == r.n_tokens for r in some)
        assert all((r.doc_id, r.start) in starts for r in some)
    assert {(r.doc_id, r.start, r.n_tokens) for r in read_tokens(manifest, ids=False).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}
    empty = write_tokens(table(spark, []), f"{folder}-none", TOKENIZER)
    assert digests(empty, f"{folder}-none").count() == 0


def test_pages_are_read_by_their_index(spark, tmp_path):
    """Of one row group of 4000 documents Spark decodes only the pages that may hold the ten wanted."""
    rows = [(k, f"text number {k} " * 5) for k in range(4000)]
    folder = f"file://{tmp_path}/pages"
    manifest = write_tokens(table(spark, rows).coalesce(1), folder, TOKENIZER)
    assert manifest.agg(F.sum("row_groups")).first()[0] == manifest.count()
    few = read_tokens(manifest, (1000, 1009))
    assert sorted(r.doc_id for r in few.collect()) == list(range(1000, 1010))
    found, plans = [], [few._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        while (name := plan.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            plan = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan()
        if "FileSourceScanExec" in plan.getClass().getName():
            found.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    assert len(found) == 1 and 10 <= found[0] <= 200


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_file(name):
    made = WordEncoder(tokenizer_file(name))
    texts = ["It's a TEST  of words\n and <|endoftext|> more", "", None, "Größe é 123"]
    flat, sizes = made.encode(texts)
    ends = np.cumsum(sizes)
    assert made.words == (name == "word_bpe_49k.json")
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert flat[a:b].tolist() == [*made.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_warc(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100
    rows = [(1, "http://a/ b\n", long), (2, None, long), (9, "u", long), (9, "u", long), (3, "s", "short"), (4, "s", "short"), (5, "n", None), (6, "e", ""), (None, "q", long), (7, "big", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    got = read_records(archive(pages, folder), folder).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        revisit = r.page_id in (1, 2, None)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload).decode() == html
    assert read_records(archive(pages.limit(0), f"{folder}0"), f"{folder}0").count() == 0


def test_cut_off_archive(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "text %d " % k * 3000) for k in range(20)], "page_id long, url string, html string")
    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")).coalesce(1)
    one = write_monoliths(rows, f"file://{tmp_path}/m").first()
    data = open(one.path, "rb").read()
    (tmp_path / "cut.warc.gz").write_bytes(data[: len(data) // 2])
    cut = spark.createDataFrame([(str(tmp_path / "cut.warc.gz"), 20)], "path string, records long")
    made = normalise(cut, f"file://{tmp_path}/n", truncated="keep")
    first = made.first()
    assert first.truncated and 0 < first.records < 20
    assert read_records(made, f"file://{tmp_path}/n", truncated="keep").count() == first.records
    with pytest.raises(Exception, match="truncated: True"):
        read_records(made, f"file://{tmp_path}/n").collect()
    with pytest.raises(Exception, match="cut off after"):
        normalise(cut, f"file://{tmp_path}/n2")
    (tmp_path / "whole.warc.gz").write_bytes(data)
    with pytest.raises(Exception, match="has 20 records, 21 expected"):
        normalise(spark.createDataFrame([(str(tmp_path / "whole.warc.gz"), 21)], "path string, records long"), f"file://{tmp_path}/n3")
    lost = normalise(spark.createDataFrame([(str(tmp_path / "whole.warc.gz"), 20)], "path string, records long"), f"file://{tmp_path}/n4")
    assert read_records(lost, f"file://{tmp_path}/n4").count() == 20
    with pytest.raises(Exception, match="20 of 19 records"):
        read_records(lost.withColumn("records", F.lit(19).cast("long")), f"file://{tmp_path}/n4").collect()


@pytest.mark.parametrize("padding", [0, 1, 5, 64, 300])
def test_padding_between_members_is_no_cut(monkeypatch, padding):
    monkeypatch.setattr(warc, "READ_BYTES", 64)
    members = [gzip.compress(warc.record(k, "u", b"payload %d " % k * 20)) + b"\0" * padding for k in range(5)]
    whole = warc.Inflated(io.BytesIO(b"".join(members)))
    assert len(list(whole)) == 5 and not whole.truncated
    cut = warc.Inflated(io.BytesIO(b"".join(members)[: -padding - 4]))
    list(cut)
    assert cut.truncated


def test_warc_ignores_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "a", "b", "c"), (2, None, "x" * 2000, "a", "b", "c")], "page_id long, url string, html string, HTML string, payload string, refers_to string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in read_records(archive(pages, f"file://{tmp_path}/w"), f"file://{tmp_path}/w").collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None)}


def chats(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")


def test_chat_round_trip(spark):
    rng = random.Random(2)
    pieces = ["\\", "#", "<", "### ", " </turn>", ": ", "é😀", "a", "\n", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd: role\\", None]), rng.choice([None, "".join(rng.choices(pieces, k=rng.randint(0, 9)))])) for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} " * 50) for t in range(200)] + [(100, None, "user", "x"), (100, 1, "user", "x"), (100, 1, "user", "x"), (101, 0, "assistant", "y" * 2_000_000)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chats(spark, rows))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode()))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.rewrites) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), False)
    assert chat.format_chats(chats(spark, [])).count() == 0


def test_rewriting_templates_are_found():
    moving = chat.Template(lambda turns: "".join(f"[{r}] {t}{' <last>' if k == len(turns) - 1 else ''}\n" for k, (r, t) in enumerate(turns)))
    *_, changed = chat.render_turns(moving, [("user", "a"), ("assistant", "b")])
    assert changed == len("[user] a")
    spans, whole, changed = chat.render_turns(chat.MARKED, [("user", "a#b"), ("assistant", ""), ("user", "a")])
    assert changed is None and [whole[c:d] for _, _, c, d in spans] == ["a\\#b", "", "a"] and spans[-1][1] == len(whole)


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([40, 30, 13, 8, 3])] + [(10, None), (11, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda n: " ".join(word() for _ in range(n))
    fifth = " ".join("zzzz" if k % 5 == 4 else w for k, w in enumerate(items[0][1].split()))
    rows = [(0, None), (1, ""), (2, filler(500)), (3, f"{filler(20)} {items[0][1].upper()}! {filler(9)}"), (4, fifth), (5, f"{filler(3000)}\n{items[1][1]}"), (6, " ".join(items[0][1].split()[:20])), (7, items[4][1]), (12, f"{filler(9)} {items[4][1]} {filler(3)}"), (8, " ".join(items[1][1].split()[:7]) + " " + filler(30)), (9, items[3][1].replace(" ", ", ")), (3, f"{items[2][1]}")]
    docs = table(spark, rows)
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert got == {(3, 0), (4, 0), (5, 1), (6, 0), (7, 4), (9, 3), (12, 4), (3, 2)}
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [0, 1, 2, 8]
    assert find_leaks(table(spark, []), bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_masks_see_all_that_the_rule_allows():
    """Every pattern of differing words that SIMILARITY allows leaves some mask a whole window, for items of any length."""
    for words in range(1, 13):
        free = words - math.ceil(words * SIMILARITY)
        for differ in itertools.combinations(range(words), free):
            assert any(all(at + o not in differ for o in m) for m in masks_of(words) for at in range(words - max(m))), (words, differ)
    assert all(list(m) != list(range(len(m))) for m in masks_of(20) + masks_of(10))


def brute_leaks(rows, items):
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    best = {}
    for i, t in rows:
        d = words(t)
        for k, x in items:
            b = words(x)
            w = min(len(b), 12)
            for diag in range(-len(b), len(d) + 1) if b else ():
                flags = [d[diag + j] == b[j] for j in range(len(b)) if 0 <= diag + j < len(d)]
                top = max((sum(flags[j : j + w]) for j in range(len(flags) - w + 1)), default=0)
                if top >= math.ceil(w * SIMILARITY) and len(flags) >= w:
                    key = (i, t, k)
                    best[key] = (max(best.get(key, (0,))[0], sum(flags)), len(b), max(best.get(key, (0, 0, 0))[2], top))
    return sorted((i, k, *v) for (i, _, k), v in best.items())


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate_module, "BROADCAST_SEEDS", -1)
    monkeypatch.setattr(decontaminate_module, "STRETCH", 16)
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abc", k=4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9, 10, 10, 11, 12, 13, 25])] + [(50, ""), (51, "... !")]
    rows = [(900, None), (901, "")]
    for k in range(160):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 1 + len(w) // 5)):
            if w:
                w[rng.randrange(len(w))] = word()
        cut = rng.randint(0, 3) if len(w) > 14 else 0
        rows.append((k, " ".join([word() for _ in range(rng.randint(0, 12))] + w[cut:] + [word() for _ in range(rng.randint(0, 12))])))
    rows += [(902, f"{items[9][1]} " * 300), (903, "abca " * 3000), (5, rows[7][1]), (5, rows[7][1])]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, TEXT string")
    got = sorted((r.doc_id, r.item_id, r.matched, r.item_words, r.best_window) for r in find_leaks(table(spark, rows), bench).collect())
    assert got == brute_leaks(rows, items) and len(got) > 100


def test_quality_learns(spark):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choices("abcdeinorst", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 200)))
    bad = lambda: " ".join("".join(rng.choices("ABCDE", k=rng.randint(2, 8))) + "!!" for _ in range(rng.randint(20, 200)))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)] + [(900, None), (901, ""), (902, good() * 100), (902, good())]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), "q") for k in range(300)] + [(901, None, "q")], "doc_id long, quality int, text string")
    docs = table(spark, rows)
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).columns == [*docs.columns, "score", "predicted"]
    scored = quality.score(docs, model, ["doc_id"]).withColumn("out", quality.held_out()).collect()
    held = [r for r in scored if r.out and r.doc_id < 300]
    assert len(scored) == len(rows) and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held) > 20
    assert all(0 <= r.score <= 1 for r in scored)
    kept = quality.filter_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in scored)
    assert quality.fit(docs, labels.limit(0)).score(b"x") == 0.5 and quality.score(table(spark, []), model).count() == 0


def test_quality_trains_to_convergence(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh", k=60)) for _ in range(200)]
    samples = [((t[:30] + "xyz" * (k % 2) + t[30:]).encode(), k % 2) for k, t in enumerate(texts)]
    monkeypatch.setattr(quality, "RATE", 3e-4)  # so slow that 700 steps end before the loss stops falling
    model = quality.train(samples)
    assert all((model.score(c) >= 0.5) == bool(y) for c, y in samples)


def test_quality_gradients(monkeypatch):
    """Against differences of the loss, for texts of one and of many pieces, with kept and with repeated activations."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 256, (n, quality.CHUNK)).astype(np.int16) for n in (1, 3, 300)]
    labels = np.array([1, 0, 1], np.float32)
    with ThreadPoolExecutor(3) as pool:
        made = quality._Trainer(texts, labels, np.arange(3), 2, pool)
        w = {k: v.astype(np.float64) for k, v in made.model.weights.items()}
        made.model.weights = w
        g = quality._gradients(made.model, texts, labels, pool)
        monkeypatch.setattr(quality, "KEPT", 0)
        again = quality._gradients(made.model, texts, labels, pool)

        def loss():
            total = 0.0
            for x, y in zip(texts, labels, strict=True):
                h = np.concatenate([made.model.chunk_scores(x[k : k + 64]) for k in range(0, len(x), 64)])
                out = np.concatenate([h.max(0), h.mean(0)]) @ w["out"] + w["out_bias"][0]
                total += np.log1p(np.exp(-out)) if y else np.log1p(np.exp(out))
            return total / 3

        for name, value in g.items():
            assert np.allclose(value, again[name], rtol=1e-4, atol=1e-7)
            for spot in rng.choice(w[name].size, min(4, w[name].size), replace=False):
                flat, step = w[name].reshape(-1), 1e-5
                old = flat[spot]
                flat[spot] = old + step
                up = loss()
                flat[spot] = old - step
                down = loss()
                flat[spot] = old
                assert (up - down) / (2 * step) == pytest.approx(float(value.reshape(-1)[spot]), rel=2e-2, abs=2e-5), name


def test_mix(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "b", "c", None])) for k in range(500)] + [(1, "w " * 40, "a"), (1, "w " * 40, "a"), (700, None, "a"), (None, "w w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rs: sorted((r.doc_id or -1, r.source or "", r.size, r.taken) for r in rs)
    assert len(got) == len(rows) and key(got) == key(again)
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * total) < 1e-6
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].target <= 2 * own[0].source_size + 1e-6 and abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 5
        assert all(r.taken <= 2 * r.size for r in own)
    clash = docs.withColumn("_copies", F.lit(1)).toDF("doc_id", "text", "source", "TEXT")
    mixed = mixing.apply_mix(clash)
    assert mixed.columns == clash.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_of_files_leaves_texts_where_they_are(spark, tmp_path, monkeypatch):
    """Rows of files are taken as often as rows of any other table, but their texts are in no shuffle, whatever the number of documents."""
    monkeypatch.setattr(mixing, "SLOT_ROWS", 16)  # several slots a file
    rng = random.Random(16)
    rows = [(7 * k - 300 if k else None, f"{k} " + "w " * rng.choice([0, 1, 5, 30, 200]), rng.choice(["a", "b", "c", None]), k) for k in range(300)]
    names = "doc_id long, text string, source string, TEXT int"
    again = [(1, "w " * 40, "a", 0), (1, "w " * 41, "a", 1), (1, "w " * 41, "b", 2), (2, None, "a", 3)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for n, own in enumerate((rows, rows + again, rows[1:] + again + [(None, "w w", "b", 4), (None, "w w w", "c", 5)], [])):
        plain = spark.createDataFrame(own, names.replace("TEXT", "x"))
        plain.repartition(3).write.parquet(f"{tmp_path}/{n}")
        files = spark.read.parquet(f"{tmp_path}/{n}").toDF("doc_id", "text", "source", "TEXT")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = mixing.apply_mix(files)
            if own is rows:
                assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            found = Counter(map(tuple, got.collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        assert got.columns == files.columns and found == Counter(map(tuple, mixing.apply_mix(plain).collect()))
        assert bool(found) == bool(own) and (not own or max(found.values()) == 2)


def test_flight_keeps_totals():
    rng = np.random.default_rng(8)
    size, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    out = mixing.flight(size, p, rng)
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-4 and ((out > 0) & (out < 1)).sum() <= 2
    same = mixing.flight(np.full(50, 7.0), np.full(50, 0.3), rng)
    assert abs(same.sum() - 15) < 1e-6 and ((same > 0) & (same < 1)).sum() <= 2
    for few in ([], [3.0], [3.0, 3.0], [5.0, 2.0, 2.0], [9000.0, 1.0, 1.0, 1.0]):
        done = mixing.landing(np.array(few), mixing.flight(np.array(few), np.full(len(few), 0.4), rng), rng)
        assert set(done) <= {0.0, 1.0}


def test_draws_keep_inclusion_probabilities():
    """Over many seeds each document is taken with its probability, and the words stay near their total although one document is half as long as all that others can offset."""
    rng = np.random.default_rng(3)
    size = np.concatenate([[1500.0, 900.0], rng.integers(1, 80, 150).astype(float)])
    p = np.concatenate([[0.5, 0.3], rng.choice([0.2, 0.5, 0.85], 150)])
    runs = 1000
    total, off = np.zeros(len(p)), []
    for seed in range(runs):
        own = np.random.default_rng(seed)
        out = mixing.landing(size, mixing.flight(size, p, own), own)
        total += out
        off.append(abs(out @ size - p @ size))
    assert (np.abs(total / runs - p) < 5 * np.sqrt(p * (1 - p) / runs) + 1e-9).all()
    assert np.mean(off) < 40 and max(off) < 160


def test_small_sources_come_near_their_words():
    """Ten documents, one of half of all words: no draw that keeps all probabilities is always near, the nearest of several is."""
    rng, off, before = np.random.default_rng(4), [], []
    for _ in range(40):
        size = np.append(rng.integers(20, 400, 9).astype(float), 1500.0)
        p = np.full(10, rng.uniform(0.5, 0.95))
        first = mixing.landing(size, mixing.flight(size, p, rng), rng)
        out = mixing.nearest(size, p, first, rng)
        off.append(abs(out @ size - p @ size) / (p @ size))
        before.append(abs(first @ size - p @ size) / (p @ size))
    assert all(a <= b for a, b in zip(off, before, strict=True)) and np.mean(off) < 0.03 < 0.1 < np.mean(before), (np.mean(off), np.mean(before))
    size = rng.integers(1, 300, 400).astype(float)
    first = mixing.landing(size, mixing.flight(size, np.full(400, 0.4), rng), rng)
    assert mixing.nearest(size, np.full(400, 0.4), first, rng) is first


def test_targets_equal_resharing(spark):
    """The closed form against the loop of the contract."""
    rng = random.Random(21)
    for trial in range(6):
        size = {s: rng.choice([0, 1, 10, 1000, 100000]) * rng.randint(1, 9) for s in "abcdefgh"[: rng.randint(1, 8)]}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
        want, left, free = {}, 1.5 * sum(size.values()), set(size)
        while free:
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * level > 2 * size[s] + 1e-9}
            if not over:
                want |= {s: weight[s] * level for s in free}
                break
            want |= {s: 2.0 * size[s] for s in over}
            left, free = left - sum(2.0 * size[s] for s in over), free - over
        sized = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(size.items())], "doc_id long, source string, size long")
        got = {r.source: r.target for r in mixing.targets(sized).collect()}
        assert got == pytest.approx(want, abs=1e-6), (size, trial)


def test_mix_of_repeated_rows_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(None, "w w w", "a")] * 60 + [(5, "w", "a")] * 9 + [(k, "w " * 4, "b") for k in range(40)] + [(99, "w " * 200_000, "b"), (98, "w " * 190_000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and max(r.size for r in got) == 200_000
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own if r.size < 100_000) + 200_000 * (s == "b")
        assert all(r.taken <= 2 * r.size for r in own)
