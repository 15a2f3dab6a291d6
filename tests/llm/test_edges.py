"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from merchlens.llm import ann, chat, line_dedup, packing, quality_classifier, quality_rules, sentencepiece_codec, simhash, token_file, warc
from merchlens.llm.tokens import TextEncoder, vocabulary_path
from merchlens.session import scratch_dir


def _labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (5, 1), (7, 0), (7, 1), (None, 1), (9, None), (10, 5)], "doc_id long, quality int")


# ------------------------------------------------------------- classifier and rules

def test_classifier_edges(spark, odd_docs, no_docs):
    out = quality_classifier.score_documents(odd_docs, _labels(spark)).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] is False for r in out if r["doc_id"] is None)
    kept = quality_classifier.keep_good(odd_docs, _labels(spark))
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
    assert quality_classifier.score_documents(no_docs, _labels(spark)).count() == 0
    none = quality_classifier.score_documents(odd_docs, _labels(spark).where("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_isotonic_pools_violators():
    x, y = quality_classifier.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [0.0, 1.5, 3.5]


def test_rules_edges(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", quality_rules.verdict(F.col("text")).alias("v")).select("doc_id", "v.*").collect()
    assert len(rows) == odd_docs.count()
    blank = [r for r in rows if r["n_words"] == 0]
    assert len(blank) == 4 and all(r["base_failed"] and not r["kept"] for r in blank)
    kept = quality_rules.clean(odd_docs)
    assert kept.columns == odd_docs.columns
    assert quality_rules.clean(no_docs).count() == 0


def test_rules_by_line():
    good = b"This is a sentence with enough words to stand on its own here today."
    other = b"Another sentence follows that shares hardly any word with what came before it."
    nav, junk, note = b"Home | About | News | Contact", b"Ab### cd$$$ ef%%%", b"Copyright 2020 by us."
    text = b"\n".join([good, nav, other, junk, b"", note])
    n_words, chars, symbols, dup, repeat, lost, base, kept, bad = quality_rules.judge(text)
    assert bad == [1, 3, 5] and not base and kept and n_words == len(text.split())
    assert quality_rules._strip(text, bad) == b"\n".join([good, other, b""])
    assert quality_rules.judge(b"\n".join([good] + [nav] * 9))[7] is False


def test_repeated_words_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 5, 8, 9, 40, 300):
        words = [b"w%d" % i for i in rng.integers(0, 2, n)]
        seen = [tuple(words[i:i + 8]) for i in range(n - 7)]
        want = {j for i, s in enumerate(seen) if seen.count(s) > 1 for j in range(i, i + 8)}
        assert quality_rules.repeated_words(words) == len(want)


def test_rules_boilerplate_is_most_of_the_line(spark):
    prose = ("The council asked her to design in wood and to assign in turn a catalog in print, while an old blog in Welsh "
             "told how a driver's license was lost beside a cookie jar in the yard of the mill.")
    inside = "They design in oak, assign in pairs, and blog in Welsh."
    fails = [b"We use cookies on this site.", b"Licensed under the MIT License.", b"All rights reserved.", b"Please sign in, or SUBSCRIBE!",
             b"Sign in log in subscribe newsletter privacy policy terms of service cookie policy click here read more now."]
    stays = [prose.encode(), inside.encode(), b"The subscriber said that signing in was slow."]
    assert [quality_rules.line_fails(x, x.split()) for x in fails + stays] == [True] * len(fails) + [False] * len(stays)
    # a document on one line stays whole, in the operator and in the SQL
    rows = [(1, prose), (2, prose + "\n" + "\n".join(x.decode() for x in fails)), (3, inside + " " + prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in quality_rules.clean(docs, max_lost_percent=100).collect()} == {1: prose, 2: prose, 3: rows[2][1]}
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", rows)
    sql = quality_rules.RULES_SQL.format(src="d", max_lost=100, extra=", cleaned")
    assert dict(con.execute(f"SELECT doc_id, cleaned FROM ({sql})").fetchall()) == {1: prose, 2: prose, 3: rows[2][1]}


# ---------------------------------------------------------------------- line dedup

def test_line_dedup_windows(spark, odd_docs, no_docs):
    a, b, c, d = ("a line that is long enough %s." % w for w in ("one", "two", "three", "four"))
    rows = [(2, "\n".join([a, b, c, d])), (1, "\n".join([a, b, c])), (3, "\n".join([d, a, b, c, d, a])), (4, "x\ny\nz"), (5, "x\ny\nz"),
            (6, None), (7, "\n".join([a] * 5)), (7, "\n".join([a] * 5)), (8, "first. " + " ".join([a, b, c, d] * 3))]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("\n".join([a, b, c]), 0) and got[2] == (d, 3)
    assert got[3][0].strip() == "\n".join([d, a]) and got[4] == ("x\ny\nz", 0) and got[5] == ("x\ny\nz", 0)
    assert got[6] == (None, 0) and got[7] == (a + "\n", 4)
    # sentences of one long line: what repeats the lines above goes
    assert got[8][1] > 0 and got[8][0].startswith("first. ")
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_lines_", "n_removed"] and out.count() == odd_docs.count()
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_cuts_lines_by_words(spark):
    # over 40 words on fewer than 240 characters: the repeated sentences inside go
    same = "We sat on a low wall by the old mill. It was cold and we had no tea. So we all ran up to the inn. "
    rows = [(1, "Al is in. " + same + "He ate a pie and so did I at six or so."), (2, "Bo is up. " + same + "No one saw us go out by the big red gate at ten.")]
    assert all(len(t) < 240 and len(t.split(" ")) > 40 for _, t in rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1].replace(same, "")}
    # exactly 40 words stay one line, of any length
    rows = [(k, " ".join(["A" * 20 + "."] * 39 + [end])) for k, end in ((1, "x"), (2, "y"))]
    assert [r["n_lines"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1, 1]


def test_line_dedup_counts_short_windows(spark):
    # twenty lines of two or three characters: no window has 40 characters, the run has
    menu = "".join(f"m{k}\n" for k in range(20))
    passage = "a passage of some length\n\n\n\n\nthat has blank lines\nand a short\nend\n"
    texts = {1: "one\n" + menu + "first end", 2: "two\n" + menu + "second end", 3: "x\n\n\n\n\ny", 4: "z\n\n\n\n\nw", 5: "five\n" + passage, 6: "six\n" + passage + "m1\nm2\nm3\n"}
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1] == (texts[1], 0) and got[2] == ("two\nsecond end", 20)
    # blank lines alone stay; inside a repeated run they go with it
    assert got[3] == (texts[3], 0) and got[4] == (texts[4], 0)
    assert got[5] == (texts[5], 0) and got[6][0].startswith("six\n") and "passage" not in got[6][0] and "\n\n" not in got[6][0]


def test_line_dedup_runs_no_python(spark, odd_docs):
    plan = line_dedup.dedup_lines(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------------------- WARC

def test_warc_edges(spark):
    big = "x" * 1200
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (3, None, big), (4, "u\r\n4%0D", None), (5, "u5%20%0A", ""), (None, "u", big), (6, "s", "é\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = scratch_dir(spark, "warc-test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    back = warc.read_archive(spark, path)
    f = {(r["page_id"], r["url"]): r for r in warc.record_fields(back, "page_id").collect()}
    assert back.count() == len(rows)
    assert f[(1, "u1")]["record_type"] == "revisit" and f[(1, "u1")]["refers_to"] == "3"
    assert f[(3, "")]["record_type"] == "response" and f[(3, "")]["refers_to"] is None
    assert f[(None, "u")]["record_type"] == "revisit" and f[(4, "u\r\n4%0D")]["content_length"] == 0
    assert (5, "u5%20%0A") in f and f[(1, "u1")]["content_length"] == 0 and f[(1, "u1")]["payload_length"] == 1200
    assert f[(2, "u2")]["date"] == "1970-01-01T00:00:00Z"
    payload = {r["page_id"]: bytes(r["payload"]) for r in back.collect()}
    assert payload[2] == big.encode() and payload[4] == b"" and payload[6] == "é\r\n\r\nWARC/1.1\r\n".encode()
    out = scratch_dir(spark, "warc-text")
    warc.warc_text(back).write.option("lineSep", "\r\n\r\n").text(out)
    read = [r for text in spark.read.text(out, wholetext=True).collect() for r in _records(text[0].encode())]
    assert sorted((h["WARC-Record-ID"], h["WARC-Type"], b) for h, b in read) == sorted(
        (f"<urn:page:{'' if i is None else i}>", "revisit" if i in (1, 2, None) else "response", b"" if i in (1, 2, None) else (t or "").encode())
        for i, _, t in rows)
    assert all(h["WARC-Date"].endswith("Z") for h, _ in read)
    empty = scratch_dir(spark, "warc-empty")
    warc.write_archive(pages.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def _records(data: bytes):
    """(header fields, block) of a plain WARC file, read by its lengths alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        header = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(header["Content-Length"])
        assert data[stop:stop + 4] == b"\r\n\r\n"
        yield header, data[start:stop]
        at = stop + 4


def test_warc_dates_from_a_column(spark):
    pages = spark.createDataFrame([(1, "u", "a", "2020-02-03 04:05:06"), (2, "u", "b", None)], "page_id long, url string, html string, t string")
    path = scratch_dir(spark, "warc-date")
    warc.write_archive(pages.withColumn("t", F.col("t").cast("timestamp")), path, date_col="t", date="2001-01-01T00:00:00Z")
    dates = {r["page_id"]: r["date"] for r in warc.record_fields(warc.read_archive(spark, path), "page_id").collect()}
    assert dates == {1: "2020-02-03T04:05:06Z", 2: "2001-01-01T00:00:00Z"}


def test_warc_finds_damage(spark):
    pages = spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")
    path = scratch_dir(spark, "warc-damage")
    warc.write_archive(pages, path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("sha1", F.lit("0" * 40))
    broken = scratch_dir(spark, "warc-broken")
    bad.write.parquet(f"{broken}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{broken}/records")
    with pytest.raises(Exception, match="payload damaged"):
        warc.read_archive(spark, broken).collect()


# ------------------------------------------------------------------------- SimHash

def test_simhash_edges(spark, odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["fp"], r["component_id"]))
    assert len(out) == odd_docs.count()
    assert by[3] == [(0, 2)] and by[4] == [(0, 2)] and (0, 2) in by[None]
    assert by[5][0][1] == 5 and by[6][0][1] == 5
    kept = simhash.representatives(odd_docs)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert kept.columns == odd_docs.columns and ids.count((False, 7)) == 1 and (False, 6) not in ids
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.representatives(no_docs).count() == 0


@pytest.mark.parametrize("shard_rows", [10 ** 9, 400, 20])
def test_links_equal_brute_force_for_any_shard_size(spark, shard_rows):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    hot = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near, hot, [np.uint64(0), np.uint64(7), np.uint64((1 << 64) - 1)]]))
    df = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(fp), 3, shard_rows)).collect()}
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    label = np.arange(len(fp))
    while True:
        new = np.array([label[close[i]].min() for i in range(len(fp))])
        if (new == label).all():
            break
        label = new
    got = {}
    for i, v in enumerate(fp.view(np.int64).tolist()):
        got.setdefault(roots.get(v, v), []).append(i)
    want = {}
    for i, v in enumerate(label.tolist()):
        want.setdefault(v, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


# ----------------------------------------------------- token files, packing, pieces

EDGE = ["", "a  b", " a", "a ", "\n", "a\nb\n\nc", "a \nb", "x\ty", "don't we'll I'm 'sfoo", "\x02q \x01", "été\nÉTÉ, ßx. İstanbul ΣΑΣ",
        "éa á", "foo.. bar!, (x) 12 345 a1b", "<|endoftext|> </w> <s>", "日本語 テスト 。", "a\r\nb", "　x   y",
        "Kelvin", "see <|endoftext|> here", "a<|endoftext|>b", "x <|EndOfText|> y", "  <|startoftext|>  z", "a\n\n\n   b \x03c  ",
        None, "\x1cy \x1d z", "\x85a \x85b", " \n ", "a    b", "====----....", "ﬁ ½ 안녕 ✨"]


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, as_text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path(name))
    if as_text:
        lib.encode_special_tokens = True
    e = TextEncoder(vocabulary_path(name), cache_words=5, controls_as_text=as_text)
    want = [x.ids for x in lib.encode_batch([t or "" for t in EDGE * 2], add_special_tokens=False)]
    for _ in range(2):
        ids, off = e.encode(pa.array(EDGE * 2))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    control = lib.token_to_id("<|endoftext|>")
    assert any(control in w for w in want) != as_text
    assert e.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_pair_walk_equals_all_merges():
    codec = sentencepiece_codec.PieceCodec(vocabulary_path("piece_bpe_32k.model"))
    known = [i for i, p in enumerate(codec.pieces) if p in codec.rank]
    rng = np.random.default_rng(2)
    short = [i for i in known if len(codec.pieces[i]) <= 3]
    pairs = [*rng.choice(known, (3000, 2)), *rng.choice(short, (5000, 2))]
    n_open = 0
    for a, b in pairs:
        left, right = codec.pieces[a], codec.pieces[b]
        is_open = codec._merge(left + right)[0] == [left, right]
        assert codec._apart(a, b) == is_open
        n_open += is_open
    assert 100 < n_open < len(pairs) - 100
    # scores that do not fall along the merges: all merges are done
    codec.edges = {i: e and (e[0], e[1], False) for i in short[:200] for e in [codec._edges(i)]}
    for a, b in rng.choice(short[:200], (500, 2)):
        left, right = codec.pieces[a], codec.pieces[b]
        assert codec._apart(a, b) == (codec._merge(left + right)[0] == [left, right])


def test_blank_runs_pass_the_word_cache():
    import sentencepiece

    path = vocabulary_path("piece_bpe_32k.model")
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.PieceCodec(path)
    whole, codec._whole = codec._whole, lambda texts: pytest.fail("a text with blank runs went whole")
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "   ", "\n", "\n\n", " \n", "the", "Quick", "fox,", "a.b", "...", "é", "日本", "\t", "12"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(3000)]
    ids, off = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == lib.encode(texts)
    assert codec.decode(ids, off) == texts


def test_pieces_equal_library_and_decode(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = vocabulary_path("piece_bpe_32k.model")
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.PieceCodec(path, cache_words=7)
    ids, off = codec.encode(pa.array(EDGE))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [lib.encode(t or "") for t in EDGE]
    assert codec.decode(ids, off) == [t or "" for t in EDGE]
    # a unigram model: the largest sum of scores (scores that no piece should take, made small enough for floats)
    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -50000)
    (tmp_path / "u.model").write_bytes(m.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    codec = sentencepiece_codec.PieceCodec(str(tmp_path / "u.model"))
    lines = ["the quick brown fox", "a  b", "日本 zz", "unbelievable thinghood, e.g."]
    ids, off = codec.encode(pa.array(lines))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [lib.encode(t) for t in lines]


def test_piece_columns_pass_nulls(spark):
    path = vocabulary_path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, text string")
    ids = df.select("id", sentencepiece_codec.encode_column(F.col("text"), path).alias("ids"))
    out = {r["id"]: r["t"] for r in ids.select("id", sentencepiece_codec.decode_column(F.col("ids"), path).alias("t")).collect()}
    assert out == {1: "a b", 2: "", 3: ""}


def test_piece_columns_empty_repeated_and_very_long(spark, odd_docs, no_docs):
    import sentencepiece

    path = vocabulary_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = odd_docs.withColumn("ids", sentencepiece_codec.encode_column(F.col("text"), path))
    rows = rows.withColumn("back", sentencepiece_codec.decode_column(F.col("ids"), path)).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(r["text"] or "") and r["back"] == (r["text"] or "")
    assert no_docs.select(sentencepiece_codec.encode_column(F.col("text"), path)).count() == 0
    assert no_docs.select(sentencepiece_codec.encode_column(F.col("text"), path).alias("i")).collect() == []


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    cases = [np.zeros(0, int), np.array([5]), np.full(1000, 7), rng.integers(0, 50, 5000), np.tile(rng.integers(0, 49000, 700), 30)]
    for a in cases:
        base, rules, sizes, seq = token_file.compress(a.astype(np.uint32))
        assert (token_file.expand(seq, base, rules, sizes) == a).all()
        assert all(len(token_file.expand(np.array([base + k]), base, rules, sizes)) == n for k, n in list(enumerate(sizes))[:50])
        for _ in range(10 if len(a) else 0):
            s = int(rng.integers(0, len(a)))
            n = int(rng.integers(0, len(a) - s + 1))
            assert (token_file.decode_range(base, rules, sizes, seq, s, n) == a[s:s + n]).all()
    assert len(seq) + 2 * len(rules) < len(a) / 4


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(1)
    cases = [rng.integers(0, rng.integers(1, 7), rng.integers(0, 500)) for _ in range(300)]
    cases += [np.zeros(5000, int), np.tile(np.arange(7), 900), rng.zipf(1.3, 30_000) % 900]
    for a in cases:
        base, rules, sizes, seq = token_file.compress(a.astype(np.uint32))
        assert (token_file.expand(seq, base, rules, sizes) == a).all()
        assert all(len(token_file.expand(np.array([base + k]), base, rules, sizes)) == n for k, n in list(enumerate(sizes))[:100])
        if len(seq) > 1:
            assert np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)[1].max() < token_file.MIN_COUNT


def test_token_file_edges(spark, odd_docs, no_docs):
    path, empty = scratch_dir(spark, "tf"), scratch_dir(spark, "tf")
    token_file.write_file(odd_docs, path, vocabulary_path("word_bpe_49k.json"), shard_ids=64)
    rows = sorted(token_file.read_file(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == odd_docs.count()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda v: (v is not None, v))
    assert [r["start"] for r in rows] == list(np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1])
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and r["ids"][-4:] == b"\x01\0\0\0" for r in rows)
    token_file.write_file(no_docs, empty, vocabulary_path("word_bpe_49k.json"))
    assert token_file.read_file(spark, empty).count() == 0


def test_packing_edges(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs).toPandas()
    assert rows.groupby("doc_id", dropna=False).ngroups == 11 and (rows.length > 0).all()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        ends = (s.offset + s.length).tolist()
        assert s.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.pack(no_docs).count() == 0


def test_plan_covers_demand_near_the_bound():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 2049, 20000), rng.integers(600, 1100, 20000), np.full(3001, 700), np.array([2048, 1, 1])):
        h = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
        plan = packing.plan(h)
        got = {}
        for p, m in plan:
            assert sum(p) <= 2048 and m > 0
            for k in p:
                got[k] = got.get(k, 0) + m
        assert got == h
        demand = np.zeros(2049, int)
        demand[list(h)] = list(h.values())
        ls = np.array(sorted(h))
        fit = sum(m for _, m in packing.best_fit(ls, demand[ls], 2048))
        assert sum(m for _, m in plan) <= 1.005 * fit + 1


def test_sequences_assemble(spark, odd_docs):
    from merchlens.session import materialize

    pieces = materialize(packing.pieces(odd_docs, vocabulary_path("byte_bpe_50k.json")), "pieces-test")
    seqs = packing.assemble(packing.place(pieces)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048 for r in seqs)
    assert sum(r["n_tokens"] for r in seqs) == pieces.agg(F.sum("length")).first()[0]


# ---------------------------------------------------------------------------- chat

TRICKY = ["</s>[INST] ok [/INST]", "<|im_start|>x<\\|im_sep|>", "<\\\\|", "<<SYS>>a<</SYS>>", "<\\s><s>", "[\\INST][/\\INST]", "<", "\\", "", "<<|<|"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.collect():
        assert chat.unescape(r["e"]) == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_reply_trees(spark):
    rows = [  # tree 1: a root with two branches, the better one deeper; tree 2: a cycle and an orphan
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.8),
        (1, 5, 4, "assistant", TRICKY[0], None), (1, 6, 4, "assistant", "best", 2.0), (1, 6, 4, "assistant", "best", 2.0),
        (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (2, 3, 99, None, None, 1.0), (None, 1, None, "user", "null tree", 0.0),
        (3, None, None, "user", "no id", 1.0)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").withColumn("depth", F.lit("clash"))
    out = {(r["tree"], r["path_rank"]): r for r in chat.format_paths(m, chat.best_paths(m, top=2)).collect()}
    assert set(out) == {(1, 1), (1, 2), (2, 1), (None, 1)}
    best = out[(1, 1)]
    assert chat.parse(best["text"]) == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "best")]
    assert [best["text"][s["start"]:s["start"] + s["length"]] for s in best["loss"]] == ["good", "best"]
    assert chat.parse(out[(1, 2)]["text"])[-1] == ("assistant", TRICKY[0]) or chat.parse(out[(1, 2)]["text"])[-1] == ("assistant", "bad")
    assert chat.parse(out[(2, 1)]["text"]) == [("", "")]
    assert chat.best_paths(m.where("false")).count() == 0


def test_deep_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i} {TRICKY[i % 10]}") for i in range(150)] + [(1, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = chat.linear(df)
    r = chat.format_paths(m, chat.best_paths(m)).collect()
    assert len(r) == 1
    want = [("user", "")] + [(role, t) for _, _, role, t in rows[:-1]]
    assert chat.parse(r[0]["text"]) == want
    n, sha, loss_chars, loss_sha, chars = chat.digest(r[0]["text"], r[0]["loss"])
    learned = "".join(t for role, t in want if role == "assistant")
    assert (n, loss_chars, loss_sha) == (151, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert sha == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()


# ------------------------------------------------------------------------------ ANN

def test_neighbours_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    same = [1.0, 2.0, 3.0, 4.0]
    rows += [(400, [0.0, 1.0, 0.0, 2.0]), (401, [-0.0, 1.0, 0.0, 2.0])]  # equal vectors
    rows += [(100 + i, same) for i in range(80)] + [(100, same), (200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]),
                                                    (260, [float("nan")] * 4), (280, [float("inf")] * 4), (300, [1.0]), (None, same), (320, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit("clash"))
    out = ann.search(df, df.where("vec_id % 20 = 0"), k=20, recall=1.0).toPandas()
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 4
          and None not in v and np.isfinite(v).all() and any(v)}
    assert set(out.query_id) == {i for i in ok if i % 20 == 0}
    for q, g in out.sort_values("rank").groupby("query_id"):
        want = sorted(((-(ok[q] * v).sum(), i) for i, v in ok.items() if i != q))[:20]
        assert list(g.vec_id) == [i for _, i in want]
    few = ann.search(df.where("vec_id < 3"), df.where("vec_id = 0"), k=20)
    assert few.count() == 2
    assert ann.search(df.where("false"), df.where("false")).count() == 0
    assert ann.search(df, df.where("false")).count() == 0


def test_neighbours_answers_of_a_block():
    rng = np.random.default_rng(3)
    vec, q, leaf = rng.integers(-2, 3, (90, 3)).astype(float), rng.normal(size=(7, 3)).round(), rng.integers(0, 6, 90)
    cells = [np.sort(rng.choice(8, n, replace=False)) for n in (1, 2, 3, 4, 5, 8, 2)]  # leaves 6 and 7 are empty
    who, ids, score = ann._answers(q, cells, vec, np.arange(90), leaf, 5)
    for i, c in enumerate(cells):
        want = sorted((-(q[i] * vec[j]).sum(), j) for j in range(90) if leaf[j] in c)[:5]
        assert [(-s, j) for s, j in zip(score[who == i], ids[who == i])] == want
    # the same answers from several trees
    again = ann._first(np.tile(who, 3), np.tile(ids, 3), np.tile(score, 3), 5)
    assert all((x == y).all() for x, y in zip(again, (who, ids, score)))
    assert all(len(x) == 0 for x in ann._first(np.empty(0, int), np.empty(0, int), np.empty(0), 5))


def test_neighbours_of_many_visits(spark):
    """A query of some thousand leaves: their answers are merged in the time of a sort."""
    x = np.random.default_rng(4).normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, df.where("vec_id % 100 = 0"), k=20, leaf=4, recall=1.0).collect()
    want = {(i, j) for i in range(0, 1500, 100) for j in [j for j in np.argsort(-(x @ x[i])) if j != i][:20]}
    assert len(found) == 300 and len({(r["query_id"], r["vec_id"]) for r in found} & want) >= 297


def test_neighbours_whatever_the_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = lambda: sorted(map(tuple, ann.search(df, df.where("vec_id % 10 = 0"), k=20, leaf=16).collect()))
    found = rows()
    for name, value in (("BLOCK", 256), ("WALK", 300), ("MERGE", 40)):  # a leaf a block, half of the queries a task
        monkeypatch.setattr(ann, name, value)
    assert len(found) == 400 and rows() == found
