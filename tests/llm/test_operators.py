"""The ten operators: awkward rows, brute-force comparisons, the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import archive, components, decontaminate, language_id, near_dedup, neighbours, pii, piece_codec, queries, secret_scan, simhash, token_counts, toxicity, vectext
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: Nulls, empty and blank texts, ties and repeated rows, a very long text; columns whose names the operators use inside.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again", "en"),
    (2, "the QUICK brown fox jumps over the lazy dog again", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t ", "de"),
    (6, "one two", "en"),
    (7, "One two", "de"),
    (7, "One two", "de"),
    (None, "ohne Nummer, aber mit Text und noch mehr Text", "de"),
    (8, LONG, "en"),
    (9, LONG + " end", "en"),
    (10, "naïve ▁ text 🦄  with  spaces <|endoftext|> token=abc123XYZ a.b@c.de +49 (30) 123456789 4111 1111 1111 1111", "fr"),
    (11, "12345 !!! ---", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for clash in ("id", "t", "n", "rep", "component", "base", "spans", "key", "hash", "h", "label", "fingerprint", "part"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def run_all(df, benchmark):
    path = P.path("piece_bpe_32k.model")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return {
        "secrets": secret_scan.digest(secret_scan.scan_secrets(df)),
        "near": near_dedup.near_duplicates(df),
        "next": neighbours.with_next(df, queries._compare, schema),
        "simhash": simhash.fingerprint(df),
        "tokens": token_counts.count_tokens(df, P.path("byte_bpe_50k.tiktoken"), specials=P.path("byte_bpe_50k.json")),
        "pieces": piece_codec.encode(df, path),
        "contamination": decontaminate.contamination(df, benchmark),
        "language": language_id.predict(df, queries.language_model(df)),
        "pii": pii.digest(pii.find_pii(df)),
        "toxicity": toxicity.predict(df, toxicity.train(df, "text", {"bad": (F.col("doc_id") % 2)}, F.col("doc_id"))),
    }


def test_every_operator_takes_awkward_rows(spark, docs):
    benchmark = spark.createDataFrame([(1, LONG[:600]), (2, None), (3, ""), (None, "x"), (4, "short item")], "item_id long, text string")
    for name, out in run_all(docs, benchmark).items():
        rows = out.collect()
        assert len(rows) == len(ROWS), name


def test_every_operator_takes_empty_tables(spark, docs):
    nothing = docs.limit(0)
    for name, out in run_all(nothing, spark.createDataFrame([], "item_id long, text string")).items():
        assert out.count() == 0, name


# --- 1 and 10 ----------------------------------------------------------------


def test_base_spans_agree_with_python(spark, table, docs):
    odd = [
        "secret=token:abcdefgh", "token: api: password=abcdefghi", "AKIAAKIA" + "A" * 14, "A password = 'abc' PASSWORD: \"abcdef\"", "x" + "a1" * 20 + "g" + "0" * 24,
        "a@b.c_d@e.f", "a@b", "a.b@c-d.e..f@g.h", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.4", "4111-1111 1111-1111 2", "+1 +12 345 67890- +", "é" * 3 + "x@y.z", "4111 1111 1111 1111,5500 0000 0000 0004", "🦄 token=abcdef", "api-key=abcdef apikey:abcdef",
    ]
    df = table.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).unionByName(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 20_000).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for rules, out in ((brute.SECRET_RULES, secret_scan.digest(secret_scan.scan_secrets(df))), (brute.PII_RULES, pii.digest(pii.find_pii(df)))):
        kinds = [k for k, *_ in rules]
        for r in out.collect():
            want = brute.base_spans(texts[r["doc_id"]], rules)
            assert r["base_sha256"] == brute.base_digest(texts[r["doc_id"]], rules), texts[r["doc_id"]][:200]
            assert [r[f"n_{k}"] for k in kinds] == [sum(x[2] == k for x in want) for k in kinds]
            assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(r["spans"].split(","))


def test_scans_stay_linear(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "+5" + "(" * 200_000, "a@" + "b." * 100_000, "password" + " " * 200_000, "0f" * 100_000, "1." * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secret_scan.scan_secrets(df).count() == pii.find_pii(df).count() == len(texts)
    assert len(secret_scan.digest(secret_scan.scan_secrets(df)).collect()) == len(pii.digest(pii.find_pii(df)).collect()) == len(texts)


def test_window_entropy(spark):
    def plain(s, w):
        w = min(w, len(s))
        best = 0.0
        for i in range(len(s) - w + 1):
            _, c = np.unique(list(s[i : i + w]), return_counts=True)
            best = max(best, float(-(c / w * np.log2(c / w)).sum()))
        return best

    cases = ["abcdefghij", "aaaaaaaaaaaaaaab", "a1b2c3d4e5f6g7h8i9j0k1l2", "zzz", "q", "Zx9/Zx9+Zx9_" * 4]
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = {r["s"]: r["e"] for r in df.select("s", secret_scan.window_entropy(F.col("s"), F.lit(8)).alias("e")).collect()}
    for s in cases:
        assert abs(got[s] - plain(s, 8)) < 1e-9


def test_entropy_findings_and_allow_list(spark):
    secret, word = "q8ZtR2mVx7LpK0sWd3NcY5", "thisisaverylongplainword2"
    df = spark.createDataFrame([(1, f"see {secret} there"), (2, word), (3, "123e4567-e89b-12d3-a456-426614174000"), (4, f"token={secret}"), (5, "EXAMPLE" + secret)], "doc_id long, text string")
    got = by_id(secret_scan.digest(secret_scan.scan_secrets(df)), "spans", "n_entropy")
    assert got[1] == (f"entropy:4:{4 + len(secret)}", 1)
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[5] == ("", 0)
    assert got[4][1] == 0 and got[4][0].startswith("assign:0:")
    assert by_id(secret_scan.redact_secrets(df), "text")[1][0] == "see <SECRET> there"


def test_pii_score_and_redaction(spark):
    df = spark.createDataFrame([(1, "bank transfer to DE89 3704 0044 0532 0130 00 now"), (2, "DE89 3704 0044 0532 0130 01"), (3, "write to a@b.de, or 10.0.0.1"), (4, None)], "doc_id long, text string").withColumn("pii", F.lit(1))
    got = by_id(pii.find_pii(df), "pii")
    assert [s["kind"] for s in got[1][0]] == ["iban"] and got[1][0][0]["score"] == 1.0
    assert "iban" not in [s["kind"] for s in got[2][0]]
    near = by_id(pii.find_pii(spark.createDataFrame([(1, "write to a@b.de"), (2, "xx a@b.de")], "doc_id long, text string")), "pii")
    assert near[1][0][0]["score"] > near[2][0][0]["score"]
    said = by_id(pii.digest(pii.find_pii(df)), "spans", "scores")
    assert said[3] == ("email:9:15,ip:20:28", "1.00,0.60") and said[1] == ("iban:17:44", "1.00") and said[4] == ("", "")
    out = by_id(pii.redact_pii(df), "text", "pii")
    assert out[3] == ("write to <EMAIL>, or <IP>", 1) and out[4] == (None, 1)


# --- 2 -----------------------------------------------------------------------


def test_pages_come_back(spark):
    big = "x" * 150
    rows = [(3, "http://a/1", big), (1, "http://a/2 b", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (1, "http://a/2 b", big), (None, "n", big), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 20 + "é"), (7, "v", "a\r\n\r\nWARC/1.1\r\n" * 20 + "é")]
    got = archive.pages_through_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).coalesce(1)).collect()
    assert len(got) == len(rows)
    want = sorted([(3, "revisit", 1, 150), (1, "response", None, 150), (1, "response", None, 150), (2, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, len(rows[7][2].encode())), (7, "revisit", 6, len(rows[7][2].encode())), (-1, "revisit", 1, 150)], key=repr)
    assert sorted([(-1 if r["page_id"] is None else r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got], key=repr) == want
    digests = {r["page_id"]: r["payload_digest"] for r in got}
    assert digests[3] == hashlib.sha256(big.encode()).hexdigest() and digests[5] == hashlib.sha256(b"").hexdigest()


def test_archive_files_are_runs_of_members_bounded_by_bytes(spark, tmp_path):
    import random

    data = random.Random(2).randbytes(5000)
    assert gzip.decompress(archive.member(data, 600)) == data and archive.member(data, 600)[-1] == archive.member(b"")[-1] == 0
    word = random.Random(1).choices
    rows = [(i, f"http://h/{i}", "".join(word("abcdefghij", k=200_000 if i == 5 else 3000))) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archive.write_arc(pages, f"{tmp_path}/arc", file_bytes=20_000)
    files = sorted(tmp_path.glob("arc/*/part-*"))
    assert len(files) >= 3 and sum(f.stat().st_size for f in files if f.stat().st_size > 30_000) < 120_000
    for f in files:
        with gzip.open(f) as stream:
            assert stream.readline().startswith(b"filedesc://")
        with gzip.open(f) as stream:
            assert all(r.content for r in archive.read_arc(stream))
    archive.arc_to_warc(archive._files(pages, f"{tmp_path}/arc"), f"{tmp_path}/warc", file_bytes=20_000)
    out = {r["page_id"]: r for r in archive.read_warcs(archive._files(pages, f"{tmp_path}/warc")).collect()}
    assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in out.items()} == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, _, t in rows}
    for f in tmp_path.glob("warc/*/part-*"):
        with gzip.open(f) as stream:
            kinds = [fields["warc-type"] for fields, _ in archive.read_warc(stream)]
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]


def test_no_pages_and_pages_without_text(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.pages_through_archives(none).count() == 0
    empty = archive.pages_through_archives(spark.createDataFrame([(1, None, None), (None, None, "")], "page_id long, url string, html string")).collect()
    assert [(r["payload_bytes"], r["record_type"]) for r in empty] == [(0, "response")] * 2


def test_arc_versions():
    for version in (1, 2):
        data = archive.version_block(version, "f.arc") + b"\n" + archive.arc_record(version, "http://h/a b", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi\n\n", "f.arc") + b"\n" + archive.arc_record(version, "http://h/", "2001", "text/plain", b"", "f.arc") + b"\n"
        got = list(archive.read_arc(io.BytesIO(data)))
        assert [(r.url, r.content) for r in got] == [("http://h/a b", b"HTTP/1.0 200 OK\r\n\r\nhi\n\n"), ("http://h/", b"")]
        assert archive.warc_date(got[0].date) == "2001-02-03T04:05:06Z" and archive.warc_date(got[1].date) == "2001-01-01T00:00:00Z"
        record = archive.warc_record(got[0], "d", None, {})
        (fields, block), = archive.read_warc(io.BytesIO(record + b"\r\n\r\n"))
        assert fields["warc-type"] == "response" and block == got[0].content
    with pytest.raises(ValueError, match="cut short"):
        list(archive.read_arc(io.BytesIO(archive.arc_record(1, "u", "2001", "t", b"abc", "f")[:-1])))
    with pytest.raises(ValueError, match="no ARC header"):
        list(archive.read_arc(io.BytesIO(b"what is this\n")))
    odd = b"http://h/ 1.2.3.4 x 1.2.3.4 20010203040506 text/html; charset=utf-8 2\nhi\n"
    (rec,) = archive.read_arc(io.BytesIO(odd))
    assert (rec.url, rec.ip, rec.date, rec.type, rec.content) == ("http://h/ 1.2.3.4 x", "1.2.3.4", "20010203040506", "text/html; charset=utf-8", b"hi")
    with pytest.raises(ValueError, match="does not match|unconverted"):
        list(archive.read_arc(io.BytesIO(odd.replace(b"20010203040506", b"20011303040506"))))
    assert b"URL IP-address Archive-date Content-type Archive-length\n" in archive.version_block(1, "f")
    assert archive.record_id("u", "d", "x") == archive.record_id("u", "d", "x") != archive.record_id("u", "d", "y")
    assert gzip.decompress(gzip.compress(b"x")) == b"x"


# --- 3 and 4 -----------------------------------------------------------------


def test_components_agree_with_brute_force(spark, table, docs):
    got = by_id(near_dedup.near_duplicates(table), "n_shingles", "component_id", "kept")
    want = brute.components([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])
    assert {i: g[:2] for i, g in got.items()} == want and all(k == (i == c) for i, (_, c, k) in got.items())
    odd = by_id(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert odd[1] == (6, 1, True) and odd[2] == (6, 1, False) and odd[7] == (1, 6, False) and odd[9][1] == 8
    assert odd[3] == odd[3][:0] + (0, 3, True) and odd[4] == (0, 4, True) and odd[5] == (0, 5, True) and odd[None][1:] == (None, True)


def test_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, "same text for all of these rows here") for i in range(300)]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.components(rows)


def test_pairs_outside_the_largest_component_of_a_bucket(spark, monkeypatch):
    """A shared beginning puts all documents into the same buckets; only the pairs are alike enough."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32, raising=False)
    base = " ".join(f"t{i}" for i in range(300))
    text = lambda g, x, own: " ".join([base, *(f"g{g}_{i}" for i in range(80 - own)), *(f"x{x}_{i}" for i in range(own))])
    rows = [(i, text(0, i, 10)) for i in range(12)] + [(100 + i, text(1 + i // 2, 100 + i, 30)) for i in range(240)]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    want = brute.components(rows)
    assert len({c for _, c in want.values()}) == 121 and got == want


def test_id_with_two_texts_ties_their_groups(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (2, b), (3, a), (3, b), (4, b)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1} and len(got) == 5


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 300)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + i] == 100 for i in range(50)) and got[300] == 300


def test_next_texts_and_likeness(spark, table):
    got = by_id(queries.op4_fingerprints(spark, "/root/testdata/sf0.001"), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next", "n_within")
    text = {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}
    order = sorted(text, reverse=True)
    prints = by_id(simhash.fingerprint(table), "fingerprint")
    for k, i in enumerate(order):
        a, b = text[i], text[order[(k + 1) % len(order)]]
        q = len(a) // 3
        assert got[i][:3] == (len(a), hashlib.sha256((a[: len(a) - q] + b[:q]).encode()).hexdigest(), prints[i][0])
    value = {i: int(f[0], 16) for i, f in prints.items()}
    for i in value:
        want = sum(bin(value[i] ^ v).count("1") <= queries.RADIUS for v in value.values()) - 1 if i % 20 == 0 else None
        assert got[i][5] == want
    assert np.mean([g[3] for g in got.values()]) > np.mean([g[4] for g in got.values()]) + 0.15


def test_radius_search_finds_all(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 20, dtype=np.uint64)]
    values = set(base)
    for v in base:
        for n in (1, 2, 3, 4):
            x = v
            for bit in rng.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    df = spark.createDataFrame([(f"{v:016x}",) for v in values], "fingerprint string")
    for blocks in (4, 6, 7):
        assert simhash.within_radius(df, df, radius=3, blocks=blocks).count() == simhash.within_radius(df, df, radius=3).count()
    assert [simhash.blocks_for(n, 3) for n in (0, 10**6, 10**9, 10**11)] == [5, 5, 6, 8]
    got = {(r["query_fp"], r["found_fp"], r["distance"]) for r in simhash.within_radius(df, df, radius=3).collect()}
    assert got == {(f"{a:016x}", f"{b:016x}", bin(a ^ b).count("1")) for a in values for b in values if bin(a ^ b).count("1") <= 3}


# --- 5 and 7 -----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_are_the_library_s(table, library, spark, docs):
    ranks, js = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
    rows = [r["text"] or "" for r in table.unionByName(docs.select(table.columns) if set(table.columns) <= set(docs.columns) else table.limit(0)).select("text").collect()] + [r[1] or "" for r in ROWS]
    want = [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]
    assert token_counts.encoder(ranks, js)(rows) == want
    assert token_counts.encoder(js)(rows) == want


ALPHABET = st.text(alphabet=st.sampled_from("abZ'sdé1٣ ,.\n\t\x85  　▁🦄가अ​<|>endoftxt"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_counts_on_odd_texts(library, text):
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert token_counts.encoder(P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"))([text]) == [want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_long_runs_of_white_space(spark, library, name):
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a " + "\t" * 300_000 + " b", "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(token_counts.count_tokens(df, P.path(name), specials=P.path("byte_bpe_50k.json")), "n_bytes", "n_tokens")
    assert [got[i] for i in range(4)] == [(len(t), len(library.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_safe_parts():
    parts = token_counts.split_safely(LONG, 1000)
    assert "".join(parts) == LONG and len(parts) > 100 and all(p.startswith(" ") for p in parts[1:])
    assert token_counts.split_safely("x" * 5000, 1000) == ["x" * 5000]
    count = token_counts.encoder(P.path("byte_bpe_50k.tiktoken"))
    assert sum(count(parts)) == count([LONG])[0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | ALPHABET, st.integers(0, 3))
def test_pieces_decode_losslessly(text, lane):
    c = piece_codec.codec(P.path("piece_bpe_32k.model"), 0.3, 5, 4)
    assert c.decode(c.encode(text, lane)) == text


def test_pieces_without_dropout_are_the_library_s(table):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    c = piece_codec.codec(P.path("piece_bpe_32k.model"), 0.0, 1, 1)
    texts = [r["text"] for r in table.select("text").collect()] + ["a  b   c", " x", "", "漢字 かな", LONG]
    ids, at = c.encode_batch(texts, [0] * len(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == sp.encode(t)


def test_long_runs_without_spaces_are_the_library_s():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    c = piece_codec.codec(P.path("piece_bpe_32k.model"), 0.0, 1, 1)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("etaoinshrdlu"), 6000)) for _ in range(20)] + ["漢字かな交じり文" * 1000, "ab" * 60_000]
    assert [c.encode(t) for t in texts] == [sp.encode(t) for t in texts]
    dropped = piece_codec.codec(P.path("piece_bpe_32k.model"), 0.3, 1, 1)
    assert all(dropped.decode(dropped.encode(t)) == t for t in texts)


def test_dropout_is_keyed_and_agrees_with_the_agenda(spark, table):
    path = P.path("piece_bpe_32k.model")
    run = lambda seed, p: by_id(piece_codec.encode(table, path, seed=seed, dropout=p).repartition(3), "n_tokens", "lossless", "ids")
    a, b, c, plain = run(1, 0.2), run(1, 0.2), run(2, 0.2), run(1, 0.0)
    assert a == b != c and all(x[1] for x in a.values())
    assert sum(x[0] for x in a.values()) > 1.05 * sum(x[0] for x in plain.values())
    back = by_id(piece_codec.decode(piece_codec.encode(table, path), path), "text")
    assert back == by_id(table, "text")
    k = piece_codec.PieceCodec(path, 0.2, 9, 1)
    words = np.unique([w for r in table.limit(40).collect() for w in r["text"].split(" ")])
    points = np.frombuffer("".join("▁" + str(w) for w in words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) + 1 for w in words])
    start = np.cumsum(size) - size
    key = k._keys(piece_codec.run_hashes(points, start, start + size), np.zeros(len(words), np.int64))
    slots = k._learn(points, start, start + size, key)
    for w, x, s in zip(words, key, slots, strict=True):
        assert tuple(k.pool[s >> 24 : (s >> 24) + (s & 0xFFFFFF)].tolist()) == k._segment("▁" + str(w), int(x))


def test_dropout_varies_between_documents_and_within_one(spark):
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, " ".join(["internationalization"] * 60)) for i in range(8)], "doc_id long, text string")
    ids = [x for (x,) in by_id(piece_codec.encode(df, path, dropout=0.3), "ids").values()]
    assert len({tuple(x) for x in ids}) == 8
    bytes_of = piece_codec.codec(path, 0.0, 1, 1).bytes_of
    for x in ids:
        words, n = [[]], 0
        for i in x:
            words[-1].append(i)
            n += len(bytes_of[i])
            if n == 21:
                words.append([])
                n = 0
        assert len({tuple(w) for w in words if w}) > 5


# --- 6, 8 and 9 --------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = docs.select("doc_id", "text").join(labels, "doc_id")
    chain = toxicity.train(known.where("doc_id % 3 > 0"), "text", {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}, F.col("doc_id"))
    rows = toxicity.predict(known.where("doc_id % 3 = 0"), chain).join(labels, "doc_id").select("is_toxic", "toxic").collect()
    right = sum(r["is_toxic"] == (r["toxic"] == 1) for r in rows)
    assert right / len(rows) > 0.9
    assert chain.models[0].chain.shape == (0,) and chain.models[1].chain.shape == (1,)


def _sigmoid(z):
    return [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z]


def test_chain_agrees_with_a_plain_one(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 12)) + (" bad" if i % 3 == 0 else "") + (" worse" if i % 4 == 0 else ""), int(i % 3 == 0), int(i % 4 == 0 or i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, b int")
    chain = toxicity.train(df, "text", {"a": F.col("a"), "b": F.col("b")}, F.col("doc_id"))
    got = by_id(toxicity.predict(df, chain), "p_a", "p_b")
    # The plain version: the same order of rows, words instead of buckets, a number at a time.
    order = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h")).collect()}
    ranked = sorted(rows, key=lambda r: order[r[0]])
    text = [sorted(set(r[1].split())) for r in ranked]
    odds = lambda p: float(np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))))

    def fit(which, earlier, y):
        x = [dict.fromkeys(text[i], 1.0) | ({"#chain": odds(earlier[i])} if earlier else {}) | {"#bias": 1.0} for i in which]
        epochs = [np.random.default_rng(e).permutation(len(x)).tolist() for e in range(4)]
        (w,) = brute.ftrl(x, [[y[i]] for i in which], epochs, alpha=1.0, beta=1.0, l1=3.0, l2=0.5, free={"#chain", "#bias"}, outputs=1, link=_sigmoid)
        return lambda i, e: _sigmoid([sum(w.get(f, 0.0) for f in text[i]) + (w.get("#chain", 0.0) * odds(e[i]) if e else 0.0) + w.get("#bias", 0.0)])[0]

    every, ya, yb = list(range(len(rows))), [r[2] for r in ranked], [r[3] for r in ranked]
    held = {}
    for f in range(3):
        model = fit([i for i in every if i % 3 != f], None, ya)
        held |= {i: model(i, None) for i in every if i % 3 == f}
    first = fit(every, None, ya)
    second = fit(every, held, yb)
    said = {i: first(i, None) for i in every}
    for i, r in enumerate(ranked):
        assert abs(got[r[0]][0] - said[i]) < 1e-6 and abs(got[r[0]][1] - second(i, said)) < 1e-6


def test_equal_texts_have_equal_probabilities(spark):
    rows = [(i, "some words that are equal" if i % 2 else " ".join(f"x{i}_{k}" for k in range(i * 7 % 90)), i % 2, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, b int")
    chain = toxicity.train(df, "text", {"a": F.col("a")}, F.col("doc_id"))
    chain.models[0].weights[:] = np.random.default_rng(1).normal(size=toxicity.DIM)
    got = by_id(toxicity.predict(df, chain), "p_a")
    assert len({got[i] for i in range(1, 200, 2)}) == 1
    assert toxicity.train(df.withColumn("a", F.lit(None).cast("int")), "text", {"a": F.col("a")}, F.col("doc_id")) is None


def test_language_model_agrees_with_a_plain_one(spark):
    import unicodedata

    rng = np.random.default_rng(3)
    words = {"en": "the and of with that this".split(), "de": "der und mit dass für über".split(), "fr": "le et avec que pour été".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 9)), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, "text", "lang", F.col("doc_id"))
    got = by_id(language_id.predict(df, model), "lang_pred", "score")
    order = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h")).collect()}
    ranked = sorted(rows, key=lambda r: order[r[0]])

    def grams(t):
        out = {}
        for k in (1, 2, 3):
            for i in range(len(t) - k + 1):
                bucket = int(np.flatnonzero(language_id._grams(language_id._points(t[i : i + k])) - sum(language_id._grams(language_id._points(t[i : i + k][a:b])) for a in range(k) for b in range(a + 1, k + 1) if b - a < k))[0])
                out[bucket] = out.get(bucket, 0) + 1
        return out

    counts = [grams(unicodedata.normalize("NFC", r[1]).lower()) for r in ranked]
    df_ = {}
    for c in counts:
        for f in c:
            df_[f] = df_.get(f, 0) + 1
    idf = lambda f: np.log((1 + len(rows)) / (1 + df_.get(f, 0))) + 1

    def features(c):
        x = {f: (1 + np.log(n)) * idf(f) for f, n in c.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        return {f: v / norm for f, v in x.items()} | {"#bias": 1.0}

    def softmax(z):
        e = [np.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    labels = sorted(words)
    x = [features(c) for c in counts]
    fit = [i for i in range(len(x)) if i % 5]
    epochs = [[int(j) for j in np.random.default_rng(e).permutation(len(fit))] for e in range(3)]
    w = brute.ftrl([x[i] for i in fit], [[float(ranked[i][2] == k) for k in labels] for i in fit], epochs, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, free=set(), outputs=3, link=softmax)
    logits = [[sum(wk.get(f, 0.0) * v for f, v in xi.items()) for wk in w] for xi in x]
    loss = lambda t: np.mean([-np.log(softmax([v / t for v in logits[i]])[labels.index(ranked[i][2])]) for i in range(0, len(x), 5)])
    assert loss(model.temperature) <= min(loss(model.temperature * 1.01), loss(model.temperature / 1.01)) + 1e-9
    for i, r in enumerate(ranked):
        p = softmax([v / model.temperature for v in logits[i]])
        assert got[r[0]][0] == labels[int(np.argmax(p))] and abs(got[r[0]][1] - max(p)) < 1e-5


def test_overlaps_agree_with_brute_force(spark, table, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    t = items[1].split()
    swapped = " ".join("zzz" if i % 9 == 4 else w for i, w in enumerate(t))
    extra = spark.createDataFrame([(90_001, "lead in words " + swapped + " and more"), (90_002, " ".join(w for i, w in enumerate(t) if i % 3)), (90_003, " ".join(t[:14])), (90_004, None)], "doc_id long, text string")
    df = table.select("doc_id", "text").unionByName(extra)
    got = by_id(decontaminate.contamination(df, benchmark), "items", "contaminated")
    for r in df.collect():
        want = brute.overlaps(r["text"], items, decontaminate.MASKS, decontaminate.WINDOW, decontaminate.SHARE)
        assert got[r["doc_id"]] == (",".join(map(str, want)), bool(want))
    assert got[90_001][1] and got[90_003][1] and not got[90_004][1]


def test_overlaps_are_found_wherever_the_rule_is_met(spark):
    rng = np.random.default_rng(3)
    fresh = iter(range(10**6))
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 14)} | {40: [f"i40x{k}" for k in range(40)], 50: ["文本没有空格"]}
    docs = []

    def add(item, places):
        swapped = [f"s{next(fresh)}" if k in places else w for k, w in enumerate(items[item])]
        docs.append([f"l{next(fresh)}" for _ in range(int(rng.integers(0, 3)))] + swapped + [f"r{next(fresh)}"])

    for n in range(1, 14):
        for i in range(n):
            for j in range(i, n):
                add(n, {i, j})
        add(n, ())
    for every in (4, 5, 6):
        add(40, set(range(every - 1, 40, every)))
    docs.append(items[50])

    def want(a, b):
        w = min(13, len(b))
        need = -(-4 * w // 5)
        return any(
            sum(a[p] == b[p - off] for p in range(s, s + w)) >= need
            for off in range(-len(b), len(a))
            for s in range(max(0, off), min(len(a), off + len(b)) - w + 1)
        )

    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string")
    got = by_id(decontaminate.contamination(df, benchmark), "items")
    assert got == {k: (",".join(str(i) for i, b in sorted(items.items()) if want(a, b)),) for k, a in enumerate(docs)}


def test_large_benchmarks_are_joined_without_broadcast(spark, table, sf, monkeypatch):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    small = by_id(decontaminate.contamination(table, benchmark), "items")
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert by_id(decontaminate.contamination(table, benchmark), "items") == small


def test_language_on_held_out_rows(spark, docs):
    out = queries.op9_language_id(spark, "/root/testdata/sf0.01")
    langs = by_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "lang")
    held = [(r["lang_pred"], langs[r["doc_id"]][0]) for r in out.where("held_out").collect()]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    odd = by_id(language_id.predict(docs, None), "lang_pred", "score")
    assert set(odd.values()) == {("und", 0.0)}
    some = by_id(language_id.predict(docs, queries.language_model(docs)), "lang_pred", "score")
    assert some[3] == some[4] == some[11] == ("und", 0.0) and some[8][0] != "und"


# --- shared parts and the pipeline -------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\x0b\x1c é", max_size=12), max_size=6))
def test_words_and_shingles(texts):
    import pyarrow as pa

    raw, off = vectext.column(pa.array(texts, pa.string()))
    hashes, first, size = vectext.words(raw, off)
    assert np.diff(first).tolist() == [len(brute.words(t)) for t in texts]
    assert size.tolist() == [len(w.encode()) for t in texts for w in brute.words(t)]
    _, at = vectext.shingles(hashes, first)
    assert np.diff(at).tolist() == [len(brute.shingles(t)) for t in texts]
    seen: dict = {}
    for w, h in zip([w for t in texts for w in brute.words(t)], hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_have_no_structural_collisions():
    import pyarrow as pa

    words = []
    for n in (10, 11, 12):
        a = "a"
        for _ in range(n):
            a += a.translate(str.maketrans("ab", "ba"))
        words += [a, a.translate(str.maketrans("ab", "ba"))]
    words += ["a" * n for n in range(1, 80)] + ["a" * n + "b" + "a" * (79 - n) for n in range(80)]
    raw, off = vectext.column(pa.array([" ".join(words)], pa.string()))
    hashes, _, _ = vectext.words(raw, off)
    assert len(set(hashes.tolist())) == len(words)
    path = P.path("piece_bpe_32k.model")
    codec, many = piece_codec.PieceCodec(path, 0.0), [w for w in words if len(w) > 1000]
    ids, at = codec.encode_batch([" ".join(many)], [0])
    assert codec.decode(ids.tolist()) == " ".join(many)
    points = np.frombuffer("".join(many).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in many])
    start = np.cumsum(size) - size
    assert len(set(vectext.run_hashes(points, start, start + size).tolist())) == len(many)


def test_pipeline_against_brute_force(spark, sf, table):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    got = by_id(corpus_pipeline.run(spark, sf), "n_tokens", "ids", "lossless")
    rows = {r["doc_id"]: r for r in table.collect()}
    said = by_id(language_id.predict(table, queries.language_model(table)), "lang_pred", "score")
    left = {i: r["text"] for i, r in rows.items() if said[i][0] != "und" and said[i][1] >= corpus_pipeline.LEAST_SCORE}
    groups = brute.components(list(left.items()))
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    left = {i: t for i, t in left.items() if not brute.overlaps(t, items, decontaminate.MASKS, decontaminate.WINDOW, decontaminate.SHARE)}
    codec = piece_codec.PieceCodec(P.path("piece_bpe_32k.model"), 0.0)
    assert set(got) == set(left)
    for i, t in left.items():
        out, at = "", 0
        for a, _, kind, b in brute.base_spans(t, brute.PII_RULES):
            if a >= at:
                out += t[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        out += t[at:]
        text = codec.decode(got[i][1])
        assert got[i][2] and (text == out or "<IBAN>" in text or "<SSN>" in text)


def test_stages_take_awkward_rows(spark, docs, sf):
    import corpus_pipeline

    df = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        if name != "pieces":
            assert out.columns == df.columns, name
        if name == "near_dedup":
            ids = [r["doc_id"] for r in out.collect()]
            assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 8, 10, 11] and None in ids
        else:
            out.collect()
        assert stage(spark, df.limit(0), sf).count() == 0, name
