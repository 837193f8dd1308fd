"""The training-data operators against brute force, round trips and odd inputs, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from artilake.llm import common, decontaminate, language, lm, media, ngram_join, packing, queries, secrets, substrings, suffixes, token_files, tokens, toxicity
from artilake.llm.common import id_remainder

ODD = [None, "", " \n", "a", "one two", "Straße ÉCOLE 12 don't <|endoftext|> ½", "x" * 3000, "same words in this text again and again " * 20, "same words in this text again and again " * 20, "日本語 テキスト Σίσυφος İ", "tab\tand\x1cseparator\x00zero"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, class string, code int"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, ("en", "de", None)[k % 3], ("s1", None)[k % 2], len(t or ""), k, "x", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "to", "mi", "re", "sun", "el"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD + ["one two"], [*range(len(ODD)), 4]).unionByName(frame(spark, ["no id"], [None])).cache()


@pytest.fixture(scope="module")
def corpus(spark):
    r, texts = random.Random(3), []
    shared = prose(99, 150)
    for k in range(60):
        words = prose(k, r.randint(20, 300)).split()
        texts.append(" ".join(words))
        if k % 5 == 0:
            near = list(words)
            near[len(near) // 2] = "changed"
            texts += [" ".join(near), " ".join(words)]
        if k % 7 == 0:
            texts.append(prose(k + 500, 30) + " " + shared + " " + prose(k + 900, 30))
    return frame(spark, texts).cache()


@pytest.mark.parametrize("op", [
    lambda d: media.features(media.read_archives(media.write_archives(d))),
    substrings.remove_repeats,
    lambda d: lm.score(d, id_remainder("doc_id", 7) == 2),
    secrets.scan,
    lambda d: token_files.read_files(d.sparkSession, token_files.write_files(d)),
    lambda d: language.identify(d, id_remainder("doc_id", 5) != 0),
    ngram_join.join,
    lambda d: toxicity.score(d, toxicity.learn(d, d.select("doc_id", F.lit(1).alias("toxic")), F.lit(True))),
])
def test_odd_and_empty_tables(spark, odd, op):
    assert op(odd).count() == odd.count()
    assert op(odd.where("false")).count() == 0


def test_packing(spark, odd):
    rows = packing.pack(odd, longest=64).collect()
    enc = tokens.encoder(tokens.tokenizer_path())
    want = Counter((i, t or "") for i, t in zip([*range(len(ODD)), 4, None], [*ODD, "one two", "no id"], strict=True))
    assert sum(1 for r in rows if r.start == 0) == sum(want.values())
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 for r in rows)
    ids = b"".join(r.ids for r in sorted((r for r in rows if r.id == 5), key=lambda r: r.start))
    assert ids == enc.ids(ODD[5]) + np.array([2], "<u4").tobytes()
    assert packing.pack(odd.where("false")).count() == 0


def test_encoder_equals_library():
    enc = tokens.Encoder(tokens.tokenizer_path())
    for text in [t for t in ODD if t] + ["'s 't x'll I'D !!'s", "\x85a\xa0b", prose(1, 50)]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, corpus):
    enc = tokens.encoder(tokens.tokenizer_path())
    rows = sorted(token_files.read_files(spark, token_files.write_files(corpus, block_tokens=2000, lanes=16, every=8, parts=3)).collect(), key=lambda r: r.id)
    start = 0
    for r, d in zip(rows, corpus.orderBy("doc_id").collect(), strict=True):
        assert r.ids == enc.ids(d.text) + np.array([1], "<u4").tobytes() and r.start == start
        start += len(r.ids) // 4


def test_block_checksums(tmp_path):
    table = token_files.Table(token_files.frequencies(np.bincount([1, 2, 2, 9], minlength=12)))
    block = token_files.write_block(table, [7, None], [3, 1], np.array([1, 2, 2, 9], np.uint32), 4, 2)
    assert token_files.read_block(table, block)[0] == [7, None]
    wide = np.arange(1000, dtype=np.uint32) % 12
    for lanes, every in ((4, 2), (7, 3), (1, 1), (64, 100)):
        table = token_files.Table(token_files.frequencies(np.bincount(wide)))
        long = token_files.write_block(table, [1], [1000], wide, lanes, every)
        assert token_files.read_block(table, long)[2].tolist() == wide.tolist()
    table.save(f"{tmp_path}/table.bin")
    assert token_files.Table.load(f"{tmp_path}/table.bin").freq.tolist() == table.freq.tolist()
    table = token_files.Table(token_files.frequencies(np.bincount([1, 2, 2, 9], minlength=12)))
    for k in (20, len(block) - 1):
        with pytest.raises(token_files.Corrupt):
            token_files.read_block(table, block[:k] + bytes([block[k] ^ 1]) + block[k + 1 :])


def test_media_round_trip_and_bad_member(spark, corpus):
    for text in ("", "a" * 192, "ä" * 500):
        n, payload = media.padded(text)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload[:n] == text.encode()
        assert media.from_png(media.to_png(payload)) == payload
    archives = media.write_archives(corpus)
    members = media.read_archives(archives, range_bytes=2000).collect()
    assert sorted((r.id, bytes(r.payload)) for r in members) == sorted((r.doc_id, media.padded(r.text)[1]) for r in corpus.collect())
    path = archives.first().path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(30)
        f.write(b"\xff\xff\xff")
    broken = media.read_archives(archives).where("error is not null").count()
    assert broken == 1
    facts = media.features(media.read_archives(archives)).collect()
    assert len(facts) == corpus.count() and sum(r.error is not None for r in facts) == 1
    assert all(r.payload_sha256 for r in facts if r.error is None)
    small = media.write_archives(corpus, archive_bytes=3000)
    assert small.count() > archives.count() and media.read_archives(small).where("error is null").count() == corpus.count()


def test_minimisers_fill_their_ranges():
    data = np.frombuffer(random.Random(3).randbytes(600_000), np.uint8)
    (key, *_), (part, _) = substrings.slices(data, np.full(300, 2000, "<u4"))
    for x in (key, part):
        filled = np.bincount(substrings.shard_of(x, 16), minlength=16)
        assert filled.max() < 1.5 * filled.mean()


def test_repeated_substrings(spark, corpus):
    docs = [(r.doc_id, r.text.encode()) for r in corpus.collect()]
    seen = Counter(t[k : k + 400] for _, t in docs for k in range(len(t) - 399))
    want = {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        want[i] = bytes(np.frombuffer(t, np.uint8)[~gone])
    for hot in (64, 1):  # with 1, every minimiser with several slices is counted by strings
        substrings.HOT = hot
        try:
            got = {r.id: bytes(r.kept) for r in substrings.remove_repeats(corpus).collect()}
        finally:
            substrings.HOT = 64
        assert got == want


def test_suffix_arrays_from_disk(tmp_path, monkeypatch):
    r = random.Random(5)
    for n, k in [(1, 1), (40, 1), (60, 2), (80, 4), (80, 30)]:
        s = np.array([r.randrange(k) for _ in range(n)], np.int64)
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        common = [0] + [next((m for m in range(n) if a + m >= n or b + m >= n or s[a + m] != s[b + m]), n) for a, b in zip(order, order[1:], strict=False)]
        for memory in (1 << 20, 4):
            monkeypatch.setattr(suffixes, "LEAST_FILE", 1)
            monkeypatch.setattr(suffixes, "DOUBLED", memory)
            got = suffixes.suffix_array(s, k, 1 << 20, memory, f"file://{tmp_path}")
            assert got[0].tolist() == order and got[1].tolist() == common
    assert not list(tmp_path.iterdir())


def test_language_model_base(spark, corpus):
    got = {r.id: r for r in lm.score(corpus, id_remainder("doc_id", 7) == 2, chunk_bytes=3000).collect()}
    words = {r.doc_id: re.findall(rb"[^\x20\x09-\x0d]+", r.text.encode().lower()) + [b" "] for r in corpus.collect()}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(got[i].base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_secrets(spark):
    key, shared = "Qx7" * 5, "EXAMPLE" * 3
    texts = [f'é password = "{key}" x', f"token: short; secret = password: {'z' * 20}", "AKIA" + "A1" * 8 + " " + "0f" * 9] + [f"api_key={shared}"] * 3
    docs = frame(spark, texts).withColumn("source", F.concat(F.lit("s"), "doc_id"))
    got = {r.id: r for r in secrets.scan(docs).collect()}
    assert [(s.start, s.kind, s.end) for s in got[0].base] == [(2, 0, 29)]
    assert got[1].base == []  # the failing match takes the word in
    assert [s.kind for s in got[2].base] == [1, 2]
    assert got[0].n_live == 1 and got[3].n_example == 1 and got[3].n_live == 0
    masked = {r.doc_id: r.text for r in secrets.masked(docs).collect()}
    assert masked[0] == 'é [SECRET]" x' and masked[1] == texts[1]


def test_ngram_join(spark, corpus):
    for width, percent in ((3, 90), (5, 80)):
        sets = {}
        for r in corpus.collect():
            w = r.text.encode().lower().split()
            sets[r.doc_id] = {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
        root = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
            if all(root[root[i]] == root[i] for i in root):
                break
        got = {r.id: (r.n, r.component_id) for r in ngram_join.join(corpus, width, percent).collect()}
        assert got == {i: (len(s), root[i]) for i, s in sets.items()}
        assert sorted(r.doc_id for r in ngram_join.keep_first(corpus, width, percent).collect()) == sorted(set(root.values()))


def test_near_copies_keep_all_rows_without_words(spark):
    texts, ids = ["", "", None, None, " \n", " \n", "", ""], [None, None, None, None, 5, 5, 6, 6]
    again = prose(7, 60)
    for extra, extra_ids in (([prose(8, 60)], [3]), ([again, again], [3, 3]), ([again, again], [None, None])):
        kept = ngram_join.keep_first(frame(spark, texts + extra, ids + extra_ids), 5, 80).collect()
        assert sorted(r.row for r in kept if r.row < len(texts)) == list(range(len(texts)))
        assert len(kept) == len(texts) + 1


def test_decontamination(spark):
    item = prose(42, 40)
    words = item.split()
    edited = " ".join(words[:20]) + " " + words[20] + "x, " + " ".join(words[21:])
    texts = [prose(1, 100) + " " + item + " " + prose(2, 50), prose(3, 30) + " " + edited.upper(), prose(4, 200), None, ""]
    items = spark.createDataFrame([(1, item), (2, None), (3, "kept short"), (3, "kept short")], "item_id bigint, text string")
    got = {(r.id, r.item_id): r.edits for r in decontaminate.find(frame(spark, texts), items).collect()}
    assert got[0, 1] == 0 and 0 < got[1, 1] <= 2 and set(got) == {(0, 1), (1, 1)}
    assert sorted(r.doc_id for r in decontaminate.keep_clean(frame(spark, texts), items).collect()) == [2, 3, 4]
    assert decontaminate.find(frame(spark, texts), items.where("false")).count() == 0


def test_decontamination_spends_the_whole_budget(spark, monkeypatch):
    def least(item, text):  # edits of the best region, cell by cell
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            above, row = row, [i]
            for j, d in enumerate(text, 1):
                row.append(min(above[j - 1] + (c != d), above[j] + 1, row[-1] + 1))
        return min(row)

    r = random.Random(8)
    for budget, lengths in ((decontaminate.BUDGET, (40, 43, 45, 47, 48, 57, 58, 59, 60, 71, 72, 73, 100)), (0.2, (41, 60, 90)), (0.45, (44,))):
        items = [(n, "".join(r.choice("abcdefghijklmnop") for _ in range(n))) for n in lengths]
        texts = [prose(1, 40), "abc"]
        for n, item in items:
            for e in (int(budget * n) - 1, int(budget * n), int(budget * n) + 1):
                x = list(item)
                for k in range(e):  # spread evenly: no long q-gram stays whole
                    x[(k + 1) * n // (e + 1) - 1] = "xyz"[k % 3]
                texts.append(f"{prose(n, 6)} {''.join(x)} {prose(n + 1, 6)}")
        want = {(d, n) for d, text in enumerate(texts) for n, item in items if least(item, text) <= int(budget * n)}
        assert {(3 + 3 * k, n) for k, n in enumerate(lengths)} <= want
        table = spark.createDataFrame(items, "item_id bigint, text string")
        assert {(x.id, x.item_id) for x in decontaminate.find(frame(spark, texts), table, budget=budget).collect()} == want
        assert {x.doc_id for x in decontaminate.keep_clean(frame(spark, texts), table, budget=budget).collect()} == set(range(len(texts))) - {d for d, _ in want}
        index = decontaminate.Index(items, budget=budget)
        once = [sorted(set(x)) for x in index.scan([" ".join(texts) * 3])]
        monkeypatch.setattr(decontaminate, "MOST_HITS", 10)  # in overlapping halves
        halves = [sorted(set(x)) for x in index.scan([" ".join(texts) * 3])]
        monkeypatch.undo()
        assert {x[0] for x in halves[0]} == {x[0] for x in once[0]} and set(halves[0]) <= set(once[0])
    with pytest.raises(ValueError):
        decontaminate.Index([], budget=1.0)


def test_language(spark):
    en, de = ["the house and the river with them"] * 5, ["das haus und der fluss mit ihnen"] * 5
    of = language.Classifier([("en", language.plain(" ".join(en))), ("de", language.plain(" ".join(de)))])
    assert of.predict("The river and the house")[0] == "en" and of.predict("der fluss und das haus")[0] == "de"
    assert of.predict("123 !!")[:2] == ("und", 0.0) and of.predict(None)[0] == "und"


def test_toxicity_counterfactual():
    rude = [f"the {g} is an idiot and scum {k}" for k, g in enumerate(["muslim", "muslim", "man", "muslim"] * 10)]
    kind = [f"the {g} walked by the river {k}" for k, g in enumerate(["christian", "woman", "christian", "man"] * 10)]
    model = toxicity.fit(rude + kind, [1] * 40 + [0] * 40, 0.5, penalty=5.0)
    free = toxicity.fit(rude + kind, [1] * 40 + [0] * 40, 0.5, penalty=0.0)
    gap = lambda m: abs(m.score("a muslim neighbour") - m.score("a christian neighbour"))
    assert model.score("you idiot scum") > 0.7 > model.score("walked by the river") and gap(model) < gap(free)


def test_hashes_of_media_texts(spark):
    rows = media.features(media.read_archives(media.write_archives(frame(spark, ["abc", "abc"])))).collect()
    assert {r.payload_sha256 for r in rows} == {hashlib.sha256(b"abc" + b" " * 189).hexdigest()} and len({(r.media_sha256, r.feature) for r in rows}) == 1


COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"],
    "op2": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op3": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7": ["doc_id"],
    "op8": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["doc_id", "n_shingles", "component_id"],
    "op10": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_by_name(spark, documents, name):
    df = queries.queries()[name](spark, SF)
    assert [c for c in df.columns if c in COLUMNS[name.split("_")[0]]] == COLUMNS[name.split("_")[0]]
    rows = df.collect()
    ids = [r.doc_id for r in rows]
    assert set(ids) <= set(documents)
    if name.startswith("op10"):
        enc = tokens.encoder(tokens.tokenizer_path())
        cut = {}
        for r in rows:
            cut.setdefault(r.doc_id, []).append(r)
        for i, pieces in cut.items():
            data, at = enc.ids(documents[i].text) + np.array([2], "<u4").tobytes(), 0
            for p in sorted(pieces, key=lambda r: r.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(data) // 4, zlib.crc32(data[4 * at : 4 * (at + p.length)]))
                at += p.length
            assert at == len(data) // 4
        assert set(cut) == set(documents)
    elif not name.startswith("op7"):
        assert sorted(ids) == sorted(documents)
    if name.startswith("op2"):
        for r in rows:
            data = (documents[r.doc_id].text or "").encode()
            payload = data + b" " * (-len(data) % 192 if data else 192)
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.payload_sha256) == (len(data), len(payload), zlib.crc32(payload[-16:]), hashlib.sha256(payload).hexdigest())
    if name.startswith("op6"):
        enc, at = tokens.encoder(tokens.tokenizer_path()), 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            data = enc.ids(documents[r.doc_id].text) + np.array([1], "<u4").tobytes()
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(data) // 4, zlib.crc32(data))
            at += r.n_tokens
    if name.startswith("op8"):
        held = [r for r in rows if r.held_out and r.lang_pred != "und"]
        assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.9 * len(held)
    if name.startswith("op1_"):
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_penalty_acts_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, free = (toxicity.learn(docs, labels, id_remainder("doc_id", 3) != 1, penalty=p) for p in (1.0, 0.0))
    held = [r.text for r in docs.where(id_remainder("doc_id", 3) == 1).limit(60).collect()]
    (change, n), (freely, m) = toxicity.swap_change(model, held), toxicity.swap_change(free, held)
    assert model.pairs == free.pairs > 100 and n == m > 50 and model.weights != free.weights and change < 0.7 * freely


def test_language_model_score(spark, corpus):
    """Against counts of whole pairs and the same weights, cell by cell."""
    got = {r.id: r for r in lm.score(corpus, id_remainder("doc_id", 7) == 2, chunk_bytes=3000).collect()}
    words = {r.doc_id: re.findall(rb"[^\x20\x09-\x0d]+", r.text.encode().lower()) + [b" "] for r in corpus.collect()}
    train = {i: w for i, w in words.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    single = Counter(w for ws in train.values() for w in ws)
    pair = Counter(p for ws in train.values() for p in zip([b" ", *ws], ws))
    n, v, hist = sum(single.values()), len(single), Counter()
    for ws in train.values():
        for h, w in zip([b" ", *ws], ws):
            c = single[h] - 1
            p2 = np.array([min((pair[h, w] - 1) / c, 1.0) if c > 0 else 0.0])
            hist[int(lm.bucket(np.array([c]))[0]), int(lm.binned(p2)[0]), int(lm.binned(np.array([(single[w] - 1) / (n - 1)]))[0])] += 1
    weights = lm.learn_weights([(*k, m) for k, m in hist.items()], v)
    for i, ws in words.items():
        want = 0.0
        for h, w in zip([b" ", *ws], ws):
            a = weights[int(lm.bucket(np.array([single[h]]))[0])]
            want += np.log10(a[0] * (min(pair[h, w] / single[h], 1.0) if single[h] else 0.0) + a[1] * single[w] / n + a[2] / (v + 1))
        assert abs(got[i].score - want) < 1e-6


def test_masking_and_first_copies_with_clashing_names(spark):
    docs = frame(spark, ["password = abcdefghijkl1", prose(1, 40), prose(1, 40), None, ""])
    for c in ("_found_spans", "_found_id", "_found_hash", "_text_hash", "_id", "_key", "_words", "_place", "id", "text_key"):
        docs = docs.withColumn(c, F.lit(7))
    masked = secrets.masked(docs)
    assert masked.columns == docs.columns and {r.doc_id: r.text for r in masked.collect()}[0] == "[SECRET]"
    kept = ngram_join.keep_first(docs.unionByName(docs.where("doc_id = 1")), 5, 80)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4]


def test_sketches_bound_the_overlap():
    r = np.random.default_rng(4)
    for n, m in ((5, 900), (300, 310), (3000, 2000)):
        pool = r.integers(0, 1 << 63, n + m, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[n // 2 : n], pool[n : n + m // 2]]))
        shared = len(np.intersect1d(a, b))
        assert shared <= ngram_join.most_shared(ngram_join.sketch(a), ngram_join.sketch(b)) <= min(len(a), len(b)) or min(len(a), len(b)) > 4 * 1024


def shuffled(spark, action) -> int:
    """Bytes of shuffle that the action's stages write."""
    ids, store = spark.sparkContext._jvm.java.util.ArrayList, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(ids(), False, False, none, ids())
        return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = total()
    action()
    return sum(v for k, v in total().items() if k not in before)


def test_sifted(spark):
    keys = [None, 0, 1, -5, *range(100, 400)]
    rows = spark.createDataFrame([(k, f"r{k}") for k in keys], "id bigint, `a.b` string")
    for wanted in ([], [None], [1, 399, -5], keys):
        few = spark.createDataFrame([(k,) for k in wanted], "other bigint")
        maybe, none = common.sifted(rows, F.col("id"), few, F.col("other"))
        assert maybe.columns == none.columns == rows.columns
        got, rest = {r.id for r in maybe.collect()}, {r.id for r in none.collect()}
        assert set(wanted) <= got and got | rest == set(keys) and not got & rest and len(got) <= len(wanted) + 2


def test_texts_that_stay_are_not_dealt_out(spark):
    """Of 400 texts of 20,000 characters three hold a secret, and two are copies: their own texts alone go through a shuffle."""
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choices("ghijklmnopqrstuvwxyz", k=9)) for _ in range(2000)) for _ in range(400)]
    texts[7], texts[200] = texts[6], texts[6]
    for k in (3, 50, 399):
        texts[k] += f" password={k:012d}"
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = common.stored(frame(spark, texts), "texts")
        masked, kept = [], []
        most = 400 * 20_000 // 4
        assert shuffled(spark, lambda: masked.extend(secrets.masked(docs).collect())) < most
        assert {r.doc_id: r.text for r in masked} == {k: t.split(" password=")[0] + " [SECRET]" if k in (3, 50, 399) else t for k, t in enumerate(texts)}
        grouped = common.stored(ngram_join.join(docs, 5, 80), "grouped")
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ngram_join, "join", lambda *_: grouped)
            assert shuffled(spark, lambda: kept.extend(ngram_join.keep_first(docs, 5, 80).collect())) < most
        assert sorted(r.doc_id for r in kept) == [k for k in range(400) if k not in (7, 200)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_first_codes_are_dealt_out_once(spark):
    """A first code takes 20 bytes or so in a shuffle, once."""
    rnd = random.Random(6)
    texts = [" ".join(f"{rnd.getrandbits(60):x}" for _ in range(2000)) for _ in range(300)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = common.stored(frame(spark, texts), "texts")
        firsts = 300 * 400
        assert shuffled(spark, lambda: ngram_join.join(docs, 5, 80).collect()) < 26 * firsts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
