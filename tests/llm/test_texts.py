import base64
import random

import pytest
import tiktoken

from taxoflow.llm import bpe, lookalike, packing, splitting, truth

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    kinds = ["abcdeét ", "   \n\t", "한글 문장은 ", "0123456789 .,", "'s't're don't ", "🙂👩‍🔬é́ﬁ", " \x1c\x1d\x85", "<|endoftext|> ", "aaaa", "\x00\x01\x7f"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    return texts + ["", " ", "\n", "a" * 3000, "x" * 300 + " " * 300 + "\n" * 300 + "y", "가" * 2000, "word\n\n next", "a  b", " \n a", "tail   "]


def test_encoder_equals_reference_and_round_trips(reference):
    e = bpe.Encoder(PATH)
    for t in odd_texts():
        ids = e.encode(t)
        assert ids == reference.encode_ordinary(t), repr(t)
        assert e.decode(ids) == t
    assert e.encode(None) == [] and e.decode([]) == ""


def test_memo_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    e = bpe.Encoder(PATH)
    for t in odd_texts()[:200]:
        assert e.encode(t) == reference.encode_ordinary(t)
        assert len(e.memo) <= 3


def test_token_sizes_equal_reference_and_are_remembered(reference, monkeypatch):
    e = bpe.Encoder(PATH)
    for t in [*odd_texts(), "x" * 500 + "-7" * 500]:
        assert e.sizes(t).tolist() == [len(reference.decode_single_token_bytes(i)) for i in reference.encode_ordinary(t)], repr(t)
    assert e.sizes(None).tolist() == []
    # Pieces that new chunks are made of are encoded once.
    seen, piece = [], e.piece
    monkeypatch.setattr(e, "piece", lambda data: seen.append(data) or piece(data))
    e.sizes(" ".join(f"https://qwzkx.example/{i}/vbnrtq" for i in range(1000, 1200)))
    assert seen and len(seen) == len(set(seen))
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    small = bpe.Encoder(PATH)
    for t in odd_texts()[:200]:
        assert small.sizes(t).tolist() == e.sizes(t).tolist() and len(small.known_sizes) <= 3 and len(small.fits) <= 6


def test_ids_column(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "FLUSH", 50)
    rows = [(i, t, 1, "x") for i, t in enumerate([*odd_texts()[:300], None, ""])]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc long, body string, k int, ids string")
    got = bpe.token_ids(df, "doc", "body", PATH).collect()
    assert len(got) == len(rows) and all(r.ids == reference.encode_ordinary(rows[r.doc][1] or "") for r in got)
    assert bpe.token_ids(df.limit(0), "doc", "body", PATH).count() == 0
    sizes = {r.doc: r.tokens for r in bpe.token_counts(df, ["doc"], "body", PATH).collect()}
    assert sizes == {r.doc: len(r.ids) for r in got}


@pytest.mark.parametrize("bucket", [500_000, 7])
def test_containers(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket)
    rng = random.Random(6)
    sizes = [int(rng.lognormvariate(4.0, 1.0)) for _ in range(3000)] + [0, None, 256, 257, 512, 5000, 256] + [100] * 500
    rows = [(i, s, "x", 1) for i, s in enumerate(sizes)]
    df = spark.createDataFrame([*rows, rows[5]], "id long, n int, part string, container int")
    got = packing.pack(df, "id", "n", 256).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r["size"]
        parts.setdefault(r.id, []).append((r.part, r.start, r["size"]))
    assert max(fill.values()) <= 256 and set(parts) == {r[0] for r in rows}
    for i, s in enumerate(sizes):
        p = sorted(parts[i])
        n = s or 0
        times = 2 if i == 5 else 1
        assert sum(x[2] for x in p) == n * times and len(p) == max(1, -(-n // 256)) * times
        if times == 1:
            assert [x[1] for x in p] == [k * 256 for k in range(len(p))]
    total = sum(fill.values())
    assert sorted(c for c in fill if fill[c]) == list(range(len([c for c in fill if fill[c]])))
    assert total / (256 * len(fill)) > 0.98
    assert packing.pack(df.limit(0), "id", "n", 256).count() == 0


def test_program_beats_nothing_and_covers():
    histogram = {3: 1000, 5: 700, 7: 400, 10: 10}
    table, used = packing.plan(histogram, 10)
    assert used >= -(-sum(k * v for k, v in histogram.items()) // 10)
    fill = [0] * used
    for s, n in histogram.items():
        for r in range(n):
            row = max((x for x in table if x[0] == s and x[1] <= r), key=lambda x: x[1])
            fill[row[2] + (r + row[4]) // row[3]] += s
    assert max(fill) <= 10 and sum(fill) == sum(k * v for k, v in histogram.items())


def test_pieces(spark, monkeypatch, reference):
    texts = odd_texts()[:50] + ["One sentence here. " * 400, "p1 words, more words\n\n" * 300, "가나다라마바사 " * 400, "z" * 9000, "한" * 3000, "🙂" * 700, "word " * 512, None, ""]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc long, text string, t string, piece int, marks string")
    by = {}
    for r in splitting.split_long(df, "doc", "text", 64, 8, PATH).collect():
        by.setdefault(r.doc, []).append(r)
    monkeypatch.setattr(splitting, "COPIED", 4000)
    monkeypatch.setattr(splitting, "RUN", 3)
    again = splitting.split_long(df, "doc", "text", 64, 8, PATH).collect()
    assert sorted(map(tuple, again)) == sorted(tuple(r) for rows in by.values() for r in rows)
    for i, t in enumerate(texts):
        n = len(reference.encode_ordinary(t or ""))
        assert (i in by) == (n > 64)
        if n <= 64:
            continue
        p = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p))) and p[0].start_token == 0 and p[-1].end_token == n
        assert all(r.tokens <= 64 and r.end_token - r.start_token == r.tokens and r.text == t[r.start_char : r.end_char] for r in p)
        assert all(a.end_token - b.start_token == 8 for a, b in zip(p, p[1:]))
        assert p[0].text + "".join(t[a.end_char : b.end_char] for a, b in zip(p, p[1:])) == t
    sentences = sorted(by[50], key=lambda r: r.piece)
    assert all(r.text.endswith(".") for r in sentences[:-1])
    assert splitting.split_long(df.limit(0), "doc", "text", 64, 8, PATH).count() == 0
    with pytest.raises(ValueError):
        splitting.split_long(df, "doc", "text", 8, 8)


SAME = [
    ("\uff21gent\uff0done", "Agent-one"), ("co\u2010op", "co-op"), ("a\u00a0b", "a b"), ("a\u3000b", "a b"), ("in\u200bvisible", "invisible"), ("\ufeffedge\u200e", "edge"), ("e\u0301", "\u00e9"), ("\ufb01le", "file"),
    ("\u0430pple", "apple"), ("\u0397ot", "Hot"), ("\u1112\u1161\u11ab", "\ud55c"), ("soft\u00adhyphen", "softhyphen"), ("\u04c0tem", "Item"), ("x\ufe0f", "x"), ("\uff76\uff9e", "\u30ac"), ("o\u034fk", "ok"),
    ("\u200b a", "a"), ("tab\there", "tab here"),
]
DIFFERENT = [("a\u2014b", "a-b"), ("a\u2013b", "a-b"), ("Apple", "apple"), ("e", "\u00e9"), ("l", "I"), ("O", "0"), ("rn", "m"), ("a  b", "a b"), ("b", "d"), ("가", "각"), ("ab", "a b")]


def test_skeletons():
    for a, b in SAME:
        assert a != b and lookalike.skeleton(a) == lookalike.skeleton(b), (a, b)
        assert lookalike.skeleton(lookalike.skeleton(a)) == lookalike.skeleton(a)
    for a, b in DIFFERENT:
        assert lookalike.skeleton(a) != lookalike.skeleton(b), (a, b)
    assert lookalike.skeleton(None) is None and lookalike.skeleton("\u200b \u00a0") == ""


def test_public_prototypes(spark):
    table = lookalike._Table(lookalike.public_prototypes(spark))
    for a, b in [*SAME, ("\u13aa", "A"), ("\ua4ee", "A"), ("\ua4f2", "I"), ("\u2c9e", "O"), ("\u217c", "l"), ("\u2163", "IV"), ("\u0475", "v"), ("\u04af", "y")]:
        assert a != b and lookalike.skeleton(a, table) == lookalike.skeleton(b, table), (a, b)
    for a, b in [*DIFFERENT, ("\u042c", "b"), ("\u0131", "i"), ("1", "l"), ("\u2013", "-"), ("\u0131", "l")]:
        assert lookalike.skeleton(a, table) != lookalike.skeleton(b, table), (a, b)


def test_lookalike_pairs(spark):
    rows = [("1", "\u0430pple", None), ("2", "apple", "\u00a0"), ("3", "apple", "\u200b"), ("4", "Apple", "x" * 70000 + "\u00a0"), ("5", None, "x" * 70000), (None, "\u0430pple", "q"), ("1", "\u0430pple", None)]
    df = spark.createDataFrame([(*r, "v", "w", "f") for r in rows], "card string, name string, quote string, value string, form string, field string")
    got = {tuple(r) for r in lookalike.lookalike_pairs(df, "card", ["name", "quote"]).collect()}
    assert got == {("name", "1", "2"), ("name", "1", "3"), ("quote", "4", "5")}
    assert lookalike.lookalike_pairs(df.limit(0), "card", ["name", "quote"]).count() == 0


def test_incident_numbers(spark):
    cases = {"7": [7], " 14326 ": [14326], "5671.0": [5671], "#10": [10], "aiid 13": [13], "[8222]": [8222], "[1, 2]": [1, 2], "1;2;": [1, 2], "AIID:3;AIID:3": [3], "['4', '5']": [4, 5], "10|20": [10, 20], "nan": [], "[]": [], "": [], None: None, "0007": [7], "9" * 30: []}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    for r in df.select("x", truth.incident_numbers(df.x).alias("n")).collect():
        assert (r.n or []) == (cases[r.x] or []), r.x


CLAIMS = "entity long, field string, value string, source string, record string, support int, r string"


def test_most_complete_then_trusted_then_smaller(spark):
    rows = [(1, "t", "abc", "B", "r9"), (1, "t", "abcd", "C", "r5"), (1, "t", "wxyz", "B", "r7"), (1, "t", "qrst", "B", "r6"), (2, "t", "same", "C", "r2"), (2, "t", "same", "C", "r1"), (3, "t", None, "A", "r1"), (None, "t", "x", "A", "r1"), (4, "t", "only", None, "r4")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:2]], CLAIMS)
    got = {r.entity: r.record for r in truth.discover(df, {"A": 3, "B": 2}, complete_first=True).collect()}
    assert got == {1: "r6", 2: "r1", 4: "r4"}
    assert truth.discover(df.limit(0), {"A": 3}, complete_first=True).count() == 0


def test_votes_learn_who_is_reliable(spark):
    # sources A, B and C agree with each other on most entities; D and E, as many as two of them, do not
    rows = []
    for e in range(40):
        rows += [(e, "t", f"v{e}", s, f"{s}{e}") for s in ("A", "B", "C")] + [(e, "t", f"wrong {s} {e}", s, f"{s}{e}") for s in ("D", "E")]
    rows += [(99, "t", "right", "A", "A99"), (99, "t", "false", "D", "D99")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CLAIMS)
    got = {r.entity: r.value for r in truth.discover(df, {}, complete_first=False).collect()}
    import hashlib

    assert got[99] == hashlib.md5(b"right").hexdigest() and all(got[e] == hashlib.md5(f"v{e}".encode()).hexdigest() for e in range(40))


def test_latest_takes_one_row(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", None), ("a", "2", "z"), (None, "3", "q")], "k string, v string, t string")
    assert [tuple(r) for r in truth.latest(df, "k", "v", ["t"]).collect()] == [("a", "z")]


def test_natural_places_in_full_width_and_before_a_long_run(spark):
    wide = "이 카드는 위험을 설명한다。 " * 40 + "사건 보고서가 접수되었다！검토가 끝났다？" * 60
    run = "words before the run. " * 8 + "z" * 4000
    df = spark.createDataFrame([(1, wide), (2, run)], "doc long, text string")
    pieces = {}
    for r in splitting.split_long(df, "doc", "text", 128, 16, PATH).orderBy("doc", "piece").collect():
        pieces.setdefault(r.doc, []).append(r)
    assert sum(p.text.rstrip().endswith(("。", "！", "？")) for p in pieces[1][:-1]) >= 0.9 * (len(pieces[1]) - 1)
    assert pieces[2][0].text.rstrip().endswith(".") and pieces[2][0].tokens < 64
