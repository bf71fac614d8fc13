"""Conversation repair, tokenizer alignment and scaled sketches against plain versions, and on odd rows."""

import base64
import collections
import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.llm import align, repair, sketches
from gatelens.llm.queries import QUERIES, vocabulary

TURNS = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


# -- operator 11


def least_audit(rows):
    """(cost, audit) by best-first search over rows and states of the wanted pattern; rows: (initial, must go, truncated)."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit
        following = [(2, "I", 0, r) for r in "ua"]
        if at < len(rows):
            initial, gone, cut = rows[at]
            following.append((3, "D", 1, None))
            if not gone:
                following += [(cut, "K", 1, initial)] + [(2 + cut, "R", 1, r) for r in "ua"]
        for more, letter, used, role in following:
            new = state if role is None else steps.get((state, role))
            if new is not None:
                heapq.heappush(heap, (cost + more, audit + letter, at + used, new))
    raise AssertionError


def plain_repair(turns, damage=True):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = []
        for _, turn, role, text in [t for t in turns if t[0] == conv]:
            role, text = (" " if x is None else x for x in (role, text))
            shown = ":".join(" " if x is None else str(x) for x in (conv, turn))
            kind = zlib.crc32(shown.encode()) % 20 if damage else 9
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            role = "user" if kind == 4 else role
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, marks = set(), collections.Counter(), []
        for _, role, text in rows:
            visible = BLANK.findall(text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = least_audit(marks)
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        lines, at, base = [], 0, 0
        for letter in audit:
            named = ["user", "assistant"][(len(lines) - base) % 2]
            if letter == "I":
                lines.append(named + ":")
                continue
            _, role, text = rows[at]
            at += 1
            if letter == "K":
                base = 1 if role[:1] == "s" else base
                lines.append(f"{role}:{text}")
            elif letter == "R":
                lines.append(f"{named}:{text}")
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_found(df, key="conv_id"):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: tuple(r[n] for n in names) for r in rows}


def test_repair_query(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_found(QUERIES["op11_conversation_repair"](spark, sf_dir)) == plain_repair(turns)


@pytest.fixture(scope="module")
def odd_turns(spark):
    draw = np.random.default_rng(3)
    rows = []
    for conv in range(60):
        for turn in range(int(draw.integers(1, 9 if conv % 3 else 60))):
            role = str(draw.choice(["user", "assistant", "system", "tool", "u", ""], p=[0.35, 0.35, 0.1, 0.1, 0.05, 0.05]))
            text = str(draw.choice(["Fine.", "cut off", "", " \t", "Why?", f"own {turn}."]))
            number = None if draw.random() < 0.1 else turn + 5 * int(draw.integers(0, 2))
            rows += [(conv, number, None if draw.random() < 0.05 else role, None if draw.random() < 0.05 else text)] * int(draw.integers(1, 3))
    rows += [(None, 1, "user", "a."), (None, None, None, None), (900, None, "user", "Hi."), (900, None, "user", "Hi.")]
    rows += [(1000, t, ["user", "assistant"][t % 2], f"turn {t}" + "." * (t % 7 > 0)) for t in range(700) if t % 13]
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_repair_odd(spark, odd_turns, damage, monkeypatch):
    monkeypatch.setattr(repair, "FAN", 2)
    turns = spark.createDataFrame(odd_turns, TURNS).withColumns({"_conv": F.lit(1), "audit": F.lit("x"), "_text": F.lit("y")})
    rows = repair.damaged(turns) if damage else repair.plain(turns)
    expected = plain_repair(odd_turns, damage)
    assert as_found(repair.repair_report(rows), "_conv") == expected
    lines = collections.defaultdict(list)
    report = repair.repair(rows)
    for r in repair.repaired(rows, report).orderBy("_conv", "place").collect():
        assert r.place == len(lines[r._conv])
        lines[r._conv].append(f"{r.role}:{r.text}")
    for conv, found in expected.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == found[-1]


def test_repair_many_copies(spark):
    """One row a thousand times: counted before it is sorted, deleted but once."""
    rows = spark.range(1000).selectExpr("7L AS conv_id", "1L AS turn", "'user' AS role", "'Same.' AS text")
    found = as_found(repair.repair_report(repair.plain(rows)), "_conv")[7]
    assert found[:7] == (0, 0, 999, 0, 999, 999 * 3 + 2, "K" + "D" * 999 + "I")


def test_chart_is_closed_and_splits_agree():
    draw = np.random.default_rng(8)
    rows = [[(str(draw.choice(list("uas"))), bool(draw.random() < 0.2), bool(draw.random() < 0.3)) for _ in range(8)] for _ in range(200)]
    columns = [np.array([[r[k] for r in piece] for piece in rows]) for k in range(3)]
    cells = repair.leaves(*columns, np.ones((200, 8), bool))
    whole = repair.spelled(repair.chart(cells))
    closed = repair.spelled(repair._closed(repair.chart(cells).copy()))
    for p, piece in enumerate(rows):
        one = [repair.spelled(cells[:, p : p + 1, k])[0] for k in range(8)]
        left = one[0]
        for cell in one[1:]:
            left = repair.combined(left, cell)
        assert whole[p] == left == closed[p]
        best = min(whole[p][g] for g in repair.GOALS if whole[p][g])
        assert best == least_audit([(c, g, int(t)) for c, g, t in piece])


# -- operator 12


def plain_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in shown}
    alphabet |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}

    def a_bytes(i):
        return bytes(alphabet[c] for c in first.id_to_token(i))

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()

    def spread(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at = out[-1][2]
        return out

    found, counts = [], collections.Counter()
    for doc, text in docs:
        a, b = [], []
        if text:
            a = spread(first.encode(" " + text, add_special_tokens=False).ids, a_bytes)
            b = spread(second.encode(text), b_bytes)
            raw = (" " + text).encode()
            if b"".join(a_bytes(i) for i, *_ in a) != raw or b"".join(b_bytes(i) for i, *_ in b) != raw:
                a, b = [], []
        links = [(i, j) for i, s, e in a for j, t, u in b if s < u and t < e] if len(a) < 3000 else None
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)))
        found.append((doc, len(a), len(b), groups, links))
        counts.update(set(links))
    most = collections.Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return collections.Counter(
        (doc, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, links in found
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_odd(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 3000)
    docs = [(r.doc_id, r.text[:700]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    odd = ["", None, " ", "  a  b\n\n\tc ", "<|endoftext|> <s></s><unk>", "▁ x", "日本 語\U0001f600 é́", "\x00\x01", "a\r\nb", "x" * 900, "word", "word"]
    rows = docs + [(None, t) for t in odd] + [(5, "word again")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_text": F.lit("t"), "n_a": F.lit(1), "a": F.lit(2)})
    got = align.align(df, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), with_groups=True)
    rows_got = got.collect()
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in rows_got) == plain_alignment(rows)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows_got if r.groups)


def test_alignment_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op12_tokenizer_alignment"](spark, sf_dir).collect()}
    assert set(got) == {d for d, _ in docs} and len(got) == len(docs)
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    second = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for doc, text in docs[::7]:
        assert got[doc].n_a == len(first.encode(" " + text, add_special_tokens=False).ids)
        assert got[doc].n_b == len(second.encode(text))
        assert got[doc].n_links == got[doc].n_a + got[doc].n_b - got[doc].n_groups


def test_byte_level_vocabulary_is_the_published_one():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {int(n): base64.b64decode(entry) for entry, n in map(bytes.split, file)}
    v = align.vocabulary(vocabulary("byte_bpe_50k.json"))
    entries = [bytes(v.data[i:j]) for i, j in itertools.pairwise(v.ends)]
    assert {n: e for n, e in enumerate(entries) if e} == ranks


# -- operator 13


def shingles(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def test_sketch_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op13_scaled_sketches"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    by_text, errors = {}, []
    for n, (doc, text) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            a, b = shingles(text), shingles(other)
            if len(a | b) > 400:
                errors.append(near - len(a & b) / len(a | b))
    assert len(errors) > 20 and np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.02


def test_sketch_odd(spark):
    big = (1 << 63) - 2
    rows = [(-5, "a b c d e f"), (None, "last of all"), (big, "x" * 9), (0, None), (0, "zero " * 40), (70000, ""), (1 << 40, "é" * 7), (0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "sketch": F.lit(2), "_next": F.lit(3)})
    got = sketches.edited_sketches(df).collect()
    assert len(got) == len(rows)
    ids = sorted({big + 1 if i is None else i for i, _ in rows})
    found = {r._id: r._next for r in sketches.successors(spark.createDataFrame([(i,) for i in ids], "_id long")).collect()}
    assert found == dict(zip(ids, ids[1:] + ids[:1], strict=True))
    follows = {r.edited_sha256 for r in got if r.doc_id == 70000}
    assert follows == {hashlib.sha256(b"").hexdigest()}
    assert {r.edited_sha256 for r in got if r.doc_id is None} == {hashlib.sha256("last of a b".encode()[:9] + b"a ").hexdigest()}
    assert {r.near_edited for r in got if r.doc_id == 70000} == {1.0}
    one = sketches.edited_sketches(df.filter("doc_id = -5")).collect()
    assert [r.near_next for r in one] == [1.0] and sketches.edited_sketches(df.filter("false")).count() == 0


def test_containment(spark):
    whole = " ".join(f"w{i}" for i in range(8000))
    part = " ".join(f"w{i}" for i in range(2000, 3000))
    df = spark.createDataFrame([(1, "a", whole), (2, "b", part), (3, "b", "w1 w2 w3")], "doc_id long, source string, text string")
    s = df.select("doc_id", "source", sketches.sketch(F.col("text")).alias("sketch"))
    rows = {r.doc_id: r.sketch for r in s.collect()}
    assert 0.1 < len(rows[1].hashes) / 7996 < 0.15 and set(rows[2].hashes) <= set(rows[1].hashes)
    both = s.filter("doc_id = 1").select(F.col("sketch").alias("x")).crossJoin(s.filter("doc_id = 2").select(F.col("sketch").alias("y")))
    inside, back = both.select(sketches.containment(F.col("y"), F.col("x")), sketches.containment(F.col("x"), F.col("y"))).first()
    assert inside == 1.0 and abs(back - 996 / 7996) < 0.05
    shares = {(r.doc_id, r.source): r.share for r in sketches.merged_containment(s, "source", "doc_id").collect()}
    assert shares[(2, "a")] == 1.0 and shares[(1, "a")] == 1.0 and shares[(1, "b")] == back


def test_empty_tables(spark):
    turns = spark.createDataFrame([], TURNS)
    report = repair.repair_report(repair.plain(turns))
    assert report.count() == 0 and repair.repaired(repair.plain(turns), report).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    rows = align.align(nothing, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()
    assert [(r.n_a, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows] == [(0, 0, 0, 0, "")] * 2
    gone = repair.damaged(spark.createDataFrame([(c, 0, "user", "Hi.") for c in range(200)], TURNS))
    dropped = {r._conv for r in gone.filter("_copies = 0").collect()}
    found = {r._conv: r for r in repair.repair_report(gone).collect()}
    assert len(found) == 200 and dropped
    for conv in dropped:
        assert tuple(found[conv])[1:-2] == (0,) * 6 and found[conv].audit == "" and found[conv].repaired_sha256 == hashlib.sha256(b"").hexdigest()
