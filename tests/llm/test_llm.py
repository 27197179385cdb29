"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from sitelens.llm import chat, fingerprint, hmm, jaccard, license, mixing, quality, spm, tokenbin, warc  # noqa: E402

BPE = P.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the "
         "river bank and count every leaf that falls into the slow green water on its way to the distant sea")


def _texts():
    base = [PROSE, PROSE, PROSE + " again", None, "", " \t\n ", "one two three", "a" * 500, "word " * 3000,
            "line one is here\nline one is here\nother\n", "Héllo wörld ▁ under line \U0001F600 <|endoftext|> x",
            "### " * 40, "no links at all in this short text of some twelve words here", "Licensed under CC BY-NC 4.0."]
    rows = [(i, t, "en" if i % 3 else None, "s1" if i % 2 else None, 1, "x") for i, t in enumerate(base)]
    return rows + [(None, "text without an id " * 4, "en", "s1", 0, None), (0, PROSE, None, None, 1, "x")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_sentencepiece_equals_library_and_round_trips(docs, empty):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = _rows(spm.encoded_documents(docs, P.path("piece_bpe_32k.model")))
    want = sorted((i is not None, i or 0, lib.encode(t or "")) for i, t, *_ in _texts())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in got) == want
    assert all(r["round_trip"] for r in got)
    assert _rows(spm.encoded_documents(empty, P.path("piece_bpe_32k.model"))) == []


def test_viterbi_fold_equals_library_for_a_unigram_model(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(P.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = spm.UNIGRAM
    for p in m.pieces:
        if p.type == spm.NORMAL:
            p.score = -math.log1p(zlib.crc32(p.piece.encode()) % 100_000) - 1
    proto = m.SerializeToString()
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
    model = spm.Model(proto=proto)
    words = sorted(set(spm.cutter(model.pairs)(PROSE + " Straße élan, x=1")))
    df = spark.createDataFrame([(w,) for w in words], "word binary")
    got = {bytes(r["word"]).decode(): r["ids"] for r in _rows(spm.word_ids(df, model))}
    score = {i: p.score for i, p in enumerate(m.pieces)}
    for w, ids in got.items():
        if w.startswith(spm.SPACE) and spm.SPACE not in w[1:]:
            want = lib.encode(w[1:])
            assert abs(sum(score[i] for i in ids) - sum(score[i] for i in want)) < 1e-4
            assert lib.decode(ids) == w[1:]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = tokenbin.pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8
    assert (tokenbin.unpack(data, bits, 1001) == ids).all()


def test_token_files(spark, docs, empty, scratch):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(BPE)
    folder = f"file://{scratch}/tok"
    manifest = tokenbin.write_tokens(docs, folder, BPE, 2, 50_257, file_ids=2_000)
    got = _rows(tokenbin.read_tokens(manifest, folder))
    want = sorted((i is not None, i or 0, lib.encode(t or "", add_special_tokens=False).ids + [2])
                  for i, t, *_ in _texts())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (a, b, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a, b, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    one = next(r for r in got if r["doc_id"] == 12)
    f = tokenbin.TokenFile(folder, one["file"])
    assert list(f.document(one["position"])) == want[[w[1] for w in want].index(12)][2]
    assert _rows(tokenbin.token_files(empty, BPE)) == []


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "<turn>user<says>\\</turn>", "", None, "plain <\\turn> x\\\\", "\n"]
    assert all(chat.unescape(chat.escape(s or "")) == (s or "") for s in said)
    turns = [(c, t, ["user", "assistant", None][t % 3], said[(c + t) % 6]) for c in range(4) for t in range(5)]
    turns += [(None, None, "assistant", "no id"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*t, 1) for t in turns], schema + ", n long")
    got = {r["conv_id"]: r for r in _rows(chat.chat_digests(df.select("conv_id", "turn", "role", "text"), BPE))}
    by = collections.defaultdict(list)
    for c, t, r, s in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0)):
        by[c].append((r or "", s or ""))
    for c, parts in by.items():
        loss = "".join(s for r, s in parts if r == "assistant")
        shown = sum(len("<turn><says></turn>") + len(chat.escape(r)) + len(chat.escape(s)) for r, s in parts)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{s}\n" for r, s in parts).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["formatted_chars"]) == (len(loss), shown)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert len(got) == len(by)
    assert _rows(chat.chat_digests(spark.createDataFrame([], schema), BPE)) == []


def _shingles(text, size):
    w = WORD.findall(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def test_fingerprints(docs, empty):
    got = _rows(fingerprint.fingerprints(docs))
    rows = sorted(((i is not None, i or 0, t or "") for i, t, *_ in _texts()))
    want = []
    for n, (_, _, t) in enumerate(rows):
        follower = rows[(n + 1) % len(rows)][2]
        q = len(t) // 4
        want.append((len(t), hashlib.sha256((t[:len(t) - q] + follower[:q]).encode()).hexdigest()))
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prose = {r["fingerprint"] for r in got if r["n_chars"] == len(PROSE)}
    assert len(prose) == 1 and len(prose.pop()) == 2 * fingerprint.BINS
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert _rows(fingerprint.fingerprints(empty)) == []


def test_fingerprint_likeness_estimates_jaccard(spark):
    w = [f"w{i}" for i in range(600)]
    pairs = [(" ".join(w[:400]), " ".join(w[s:400 + s])) for s in (0, 20, 60, 150, 400 - 200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "fa"), "b", "fb")
    for r in df.select("a", "b", fingerprint.likeness("fa", "fb").alias("j")).collect():
        a, b = _shingles(r["a"], 5), _shingles(r["b"], 5)
        assert abs(r["j"] - len(a & b) / len(a | b)) < 0.12


def test_quality_counts_and_outliers(spark, docs, empty):
    got = _rows(quality.quality(docs))
    def base(t):
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
                len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(base(t) for _, t, *_ in _texts())
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert _rows(quality.quality(empty)) == []
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    rows = [(i, " ".join(word() + ("###" if i % 10 == 0 else "") for _ in range(60)), "en", "s") for i in range(300)]
    kept = {r["doc_id"]: r["kept"] for r in _rows(quality.quality(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))}
    assert [i for i in kept if not kept[i]] and all(kept[i] == (i % 10 != 0) for i in kept)


def _brute_groups(rows):
    sets = {i: _shingles((t or "").encode().lower().decode("utf-8", "surrogatepass"), 4) for i, t in rows}
    top = {i: i for i in sets}
    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_groups(spark, docs, empty):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t, *_ in _texts() if i is not None][:-1]
    for g in range(6):                         # chains of gradual edits, a shared passage, copies
        w = [f"g{g}w{rng.integers(1000)}" for _ in range(120)]
        for v in range(12):
            rows.append((100 + 20 * g + v, " ".join(w) + (" " + PROSE if v % 2 and g < 2 else "")))
            if v % 4 != 3:
                w[int(rng.integers(len(w)))] = f"new{rng.integers(10 ** 6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in _rows(jaccard.similar_groups(df))}
    assert got == _brute_groups(rows)
    edge = _rows(jaccard.similar_groups(docs))
    assert len(edge) == len(_texts()) and sum(r["doc_id"] is None for r in edge) == 1
    assert _rows(jaccard.similar_groups(empty)) == []


def test_warc(spark, scratch):
    big = "<p>" + "x" * 200 + "é</p>"
    pages = [(5, "http://a/%20\nb", big), (3, "http://b", big), (7, None, big), (9, "u", None), (10, "u", "tiny"),
             (11, "u", "tiny"), (None, "n", big), (3, "http://b", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    folder = f"file://{scratch}/warc"
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                   r["target_uri"]) for r in _rows(warc.archive_pages(df, folder))), key=str)
    want = []
    for i, u, h in pages:
        body = (h or "").encode()
        again = len(body) >= 100 and i != 3
        want.append((i or -1, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                     3 if again else None, u or ""))
    assert got == sorted(want, key=str)
    heads = warc.read_warc(spark, folder, "record_type string, record_id string").filter("record_type = 'revisit'")
    assert heads.count() == 3
    assert _rows(warc.archive_pages(df.limit(0))) == []


def test_warc_reader_takes_plain_files(spark, scratch):
    body = [warc.warc_record("response", warc.record_id(i), f"http://{i}", "d", b"p" * i, i, None) for i in range(3)]
    with open(f"{scratch}/a.warc", "wb") as f:
        f.write(b"".join(body))
    got = warc.read_warc(spark, f"file://{scratch}").collect()
    assert sorted((r["target_uri"], bytes(r["payload"])) for r in got) == [(f"http://{i}", b"p" * i) for i in range(3)]


def test_license_scan(spark, empty):
    filler = " ".join(f"filler{i}" for i in range(70))
    rows, want = [], set()
    for n, (name, text) in enumerate(sorted(license.TEMPLATES.items())):
        rows.append((n, f"{filler} {text.upper()}\n{filler}"))
        want.add((n, name))
    rows += [(50, filler), (51, None), (52, ""), (53, "Permission is hereby granted, free of charge")]
    got = _rows(license.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    found = {(r["doc_id"], r["license_id"]) for r in got}
    assert want <= found and all(i < 50 for i, _ in found)
    assert all(r["containment"] >= 0.8 for r in got)
    assert license.miss_probability(7 / 9) < 1e-5
    assert _rows(license.scan(empty)) == []


def test_mixing_meets_margins(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(5, 60)), ["en", "de"][int(i % 5 == 0)], ["a", "b", "c"][int(rng.integers(3))],
             f"t{rng.integers(2)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    targets = {"source": {"a": 1, "b": 1, "c": 2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"t0": 0.5, "t1": 0.5}}
    cells = df.selectExpr("*", "size(split(trim(text), ' ')) n").groupBy("source", "lang", "topic").agg({"n": "sum"})
    cells = cells.withColumnRenamed("sum(n)", "tokens").withColumn("cell", mixing.cell_name())
    fitted = mixing.rake(cells, targets=targets).toPandas()
    share = lambda m: (fitted.groupby(m).weight.sum() / fitted.weight.sum()).to_dict()
    assert share("source") == pytest.approx({"a": 0.25, "b": 0.25, "c": 0.5}, abs=1e-3)
    assert share("lang") == pytest.approx({"en": 0.6, "de": 0.4}, abs=1e-3)
    got = mixing.mix(df, targets=targets, keep=0.5).toPandas()
    assert (got.n_tokens * got.probability).sum() / got.n_tokens.sum() == pytest.approx(0.5, abs=1e-6)
    edge = _rows(mixing.mix(docs))
    assert len(edge) == len(_texts()) and all(0 < r["probability"] <= 1 for r in edge)
    assert _rows(mixing.mix(empty)) == []


def test_hmm_forward_equals_brute_force():
    rng = np.random.default_rng(0)
    model = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(4), 2).T)
    seqs = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 3, 6, 3)]
    for some, obs, lens in hmm.side_by_side(seqs, 8):
        for i, got in zip(some, model.loglik(obs, lens)):
            paths = np.ndindex(*[2] * len(seqs[i]))
            total = sum(model.start[p[0]] * np.prod([model.emit[o, s] for o, s in zip(seqs[i], p)])
                        * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) for p in paths)
            assert got == pytest.approx(math.log(total))
        start, moves, emits, _ = model.expected(obs, lens)
        assert start.sum() == pytest.approx(len(some))
        assert emits.sum() == pytest.approx(lens.sum()) and moves.sum() == pytest.approx((lens - 1).sum())


def test_lm_scores(spark, docs, empty):
    got = _rows(hmm.score(docs, iterations=1, states=2))
    texts = [(i, hmm.cut(t or "")) for i, t, *_ in _texts()]
    test = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter(w for i, ws in texts if not test(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((i or 0, len(ws), sum(count[w] > 0 for w in ws), round(sum(
        math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in texts)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert _rows(hmm.score(empty, iterations=1)) == []


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "source_mixing", "sentencepiece"]
    rows = [(i, f"{PROSE} number {i // 2} " + " ".join(f"u{i // 2}x{j}" for j in range(40)), "en", "s1", 1)
            for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))


def test_latin_words_are_cut_like_all_words():
    import random

    from sitelens.llm.wordbpe import LATIN, LATIN_PATTERN, NOT_LATIN, PATTERN
    pick = random.Random(5)
    every, some = [chr(c) for c in range(LATIN)], list(" \t\n'strevlmd19a\xe9.\x85\xa0\x1cǅ\xb2")
    for i in range(2000):
        text = "".join(pick.choices(every if i % 2 else some, k=pick.randint(0, 40)))
        assert NOT_LATIN.search(text) is None
        assert LATIN_PATTERN.findall(text) == PATTERN.findall(text)
    assert NOT_LATIN.search("aЖb") is not None


def _brute_groups_of(rows, size, percent):
    sets = {i: _shingles((t or "").lower(), size) for i, t in rows}
    top = {i: i for i in sets}
    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def _gradual_copies():
    rng, rows = np.random.default_rng(11), []
    for g in range(12):                        # copies of one text with 1 to 5 of 200 words changed, some shortened
        w = [f"g{g}w{i}" for i in range(200)]
        rows.append((100 * g, " ".join(w)))
        for v in range(1, 6):
            x = list(w)
            for at in rng.choice(200, v, replace=False):
                x[at] = f"new{rng.integers(10 ** 6)}"
            rows.append((100 * g + v, " ".join(x[:len(x) - 4 * (v % 3)])))
    return rows


def test_near_duplicate_stage_takes_five_words_and_eighty_percent(spark):
    import corpus_pipeline
    rows = _gradual_copies()
    pairs = [(_shingles(a, 5), _shingles(b, 5)) for _, a in rows for _, b in rows if a < b]
    assert sum(0.8 <= len(a & b) / len(a | b) < 0.85 for a, b in pairs) >= 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _brute_groups_of(rows, 5, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in _rows(
        jaccard.similar_groups(df, span=5, percent=80))}
    assert got == want and want != _brute_groups_of(rows, 4, 85)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == {c for _, c in want.values()}
    strict = {c for _, c in _brute_groups_of(rows, 4, 85).values()}
    assert len(kept) < len(strict)             # what op6's shingles and percent would keep


def test_sentencepiece_words_about_the_mask_length_equal_the_library(spark):
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    lib, cut = sentencepiece.SentencePieceProcessor(model_file=path), spm.cutter(spm.Model(path).pairs)
    texts = [head + c * n for n in range(59, 66) for c in "-=_a " for head in ("", "x ", "x")]
    texts += [(PROSE.replace(" ", "") * 2)[i:i + n] for n in range(59, 66) for i in range(3)]
    lengths = {len(w.decode()) for t in texts for w in cut(t)}
    assert {61, 62, 63} <= lengths
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in _rows(spm.encoded_documents(df, path))}
    assert got == {i: (lib.encode(t), True) for i, t in enumerate(texts)}


def test_mixed_tokens_meet_the_margins_under_the_bound(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):                       # a hot source, rare languages, one of them in one source only
        lang = ["en"] * 90 + ["de"] * 6 + ["es"] * 3 + ["fr"]
        source = ["hot"] * 8 + ["b", "c"]
        pick = (lang[int(rng.integers(100))], source[int(rng.integers(10))])
        rows.append((i, "w " * int(rng.integers(5, 60)), pick[0], "b" if pick[0] == "fr" else pick[1],
                     f"t{rng.integers(2)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    got = mixing.mix(df).toPandas()
    got["kept"] = got.n_tokens * got.probability
    assert got.probability.between(0, 1).all() and (got.probability == 1).any()
    assert 0.1 < got.kept.sum() / got.n_tokens.sum() <= 0.8 + 1e-9
    told = {(r["margin"], r["value"]): r for r in _rows(mixing.margin_shares(df))}
    for m in mixing.MARGINS:
        smooth = got.groupby(m).n_tokens.sum() ** mixing.SMOOTHING
        want, reached = (smooth / smooth.sum()).to_dict(), (got.groupby(m).kept.sum() / got.kept.sum()).to_dict()
        assert reached == pytest.approx(want, rel=1e-3)
        for v in want:
            assert told[m, v]["target"] == pytest.approx(want[v])
            assert told[m, v]["reached"] == pytest.approx(reached[v], rel=1e-6)
    assert len(told) == 9


def test_license_scan_tells_licenses_apart_and_takes_torn_texts(spark):
    filler = lambda n: " ".join(f"filler{i}" for i in range(n))
    t, rows, want = license.TEMPLATES, [], set()
    for n, name in enumerate(("mit", "isc", "mpl-2.0", "unlicense", "bsd-2-clause")):
        w = t[name].split()                    # halves with two thirds of the template's length between them
        rows.append((n, " ".join([filler(90), *w[:len(w) // 2], filler(len(w) * 2 // 3), *w[len(w) // 2:], filler(90)])))
        want.add((n, name))
    rows.append((20, f"{filler(50)} {t['bsd-2-clause']} {filler(50)}"))
    rows.append((21, f"{filler(50)} {t['bsd-2-clause']} {t['bsd-3-clause']} {filler(50)}"))
    rows.append((22, f"{filler(50)} {t['cc-by-sa-4.0']}"))
    rows.append((23, f"{filler(50)} {t['mit'].split(':')[0]} {filler(300)}"))      # no conditions, no warranty
    for n, kind in ((30, ""), (31, "Lesser "), (32, "Affero ")):
        rows.append((n, f"""{filler(50)} This program is free software: you can redistribute it and/or modify it under the
            terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version
            3 of the License, or (at your option) any later version. {filler(50)}"""))
        want.add((n, f"{kind[:1].lower()}gpl-3.0"))
    rows.append((33, rows[-3][1].replace("3 of the License", "2 of the License")))
    want |= {(20, "bsd-2-clause"), (21, "bsd-2-clause"), (21, "bsd-3-clause"), (22, "cc-by-sa-4.0")}
    got = {(r["doc_id"], r["license_id"]) for r in _rows(license.scan(
        spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == want and license.miss_probability(license.CONTAINMENT) < 1e-7
