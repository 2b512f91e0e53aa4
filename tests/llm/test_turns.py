"""Chat formatting and repair of conversations against brute force."""

import collections
import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from posterra.llm import chat, queries, repair

BITS = ["</s>", "<", "s>", "[INST]", "[", "INST]", "[/INST]", "\\", "<|turn|>", "<|text|>", "é", "日", "a", "\n", "", "😀", "|>", "<|", "\r"]
SCHEMA = "conv_id long, turn long, role string, text string, part long, formatted string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", "y") for r in rows], SCHEMA)


def grouped(rows, order):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    for own in out.values():
        own.sort(key=order)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- formatting -----------------------------------------------------------------------------------


def chatter(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(200), None]:
        for t in range(rng.randint(1, 6)):
            text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 200)))
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "<|text|>x", None, ""]), rng.choice([None, text, text, text])))
    rows += [(7777, t, rng.choice(["user", "assistant"]), f"{t}</s>" * rng.randint(0, 5)) for t in range(3000)]
    rows += [(8888, 0, "user", "[INST]" * 200_000), (8888, 1, "assistant", "\\" * 1_000_000)]
    return rows + [(5, 0, "user", "same")] * 3


@pytest.mark.parametrize("held", [1 << 23, 10])
def test_formatted_and_read_back(spark, monkeypatch, held):
    monkeypatch.setattr(chat, "HELD", held)
    rows = chatter(3)
    df = table(spark, rows)
    hashes = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).distinct().collect()}
    pieces = chat.formatted(df)
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    want = grouped(rows, lambda r: (-1 if r[1] is None else r[1], r[2] is not None, r[2] or "", hashes[r[3]]))
    assert set(got) == set(want)
    chars = collections.Counter()
    for p in sorted(pieces.collect(), key=lambda p: p.part):
        chars[p.conv_id] += len(p.formatted)
        assert sum(p.formatted.count(m.decode()) for m in chat.CONTROL) == 3 * p.n_turns
        said = [t for r, t in chat.parsed(p.formatted) if r == "assistant"]
        assert [chat.unescaped(p.formatted[s.start : s.end]) for s in p.loss] == said
    for c, own in want.items():
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert tuple(got[c])[1:5] == (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(learned), sha(learned))
        assert got[c].formatted_chars == chars[c]
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_pieces_of_a_task_and_of_many():
    """A conversation that goes on over parts and ones that stand whole give the same digests."""
    texts = [[("user", f"{c} {t}"), ("assistant", "</s>" * t)] for c in range(4) for t in range(3)]
    written = lambda turns: "".join(f"<|turn|>{r}<|text|>{t.replace('</s>', '<' + chr(92) + '/s>')}</s>" for r, t in turns)
    rows = [(n // 3, n, None, None, None, None, None, written(t), []) for n, t in enumerate(texts)]
    assert [list(chat._joined(iter(batches))) for batches in [chat._grouped(iter(rows), chat._READ_TYPES)]][0] == [
        (c, 6, sha("".join(f"{r}\n{t}\n" for turns in texts[3 * c : 3 * c + 3] for r, t in turns)), 0, sha(""), sum(len(written(t)) for t in texts[3 * c : 3 * c + 3])) for c in range(4)
    ]


def test_not_formatted():
    for text in ("x", "<|turn|>user</s>", "a<|turn|>user<|text|>b</s>"):
        with pytest.raises(ValueError, match="not a formatted"):
            chat.parsed(text)


# --- repair ---------------------------------------------------------------------------------------


def brute(rows):
    """Cheapest edits by a search over whole audits; rows are (turn, role, text)."""
    faults, seen = [], set()
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    counts = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in "bdt"), illegal)
    after, whole = {"0": "u", "s": "u", "a": "u", "u": "a"}, {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state, len(audit)) in done:
            continue
        done.add((i, state, len(audit)))
        if i == len(rows) and state in "0a":
            return *counts, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out))
        new = after[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, new, (*out, (whole[new], ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if faults[i] in ("", "t"):
            more = 3 if faults[i] else 0
            if role[:1] == "s" and state == "0":
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, "s", (*out, (role, text))))
            if role[:1] == new:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, new, (*out, (role, text))))
            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new, (*out, (whole[new], text))))
    return None


def broken(seed):
    rng = random.Random(seed)
    texts = ["a.", "b", "c!", "", "  ", "d? ", "e.", None]
    rows = []
    for c in [*range(300), None]:
        for t in range(rng.randint(0, 9)):
            turn = None if rng.random() < 0.05 else rng.randint(0, 12) if rng.random() < 0.3 else t
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"x{rng.random()}."))
    return rows + [(5000, t, rng.choice(["user", "assistant", "user", "system", "x"]), rng.choice([f"{t}.", f"{t}", "y.", ""])) for t in range(500)]


@pytest.mark.parametrize(("segment", "batch"), [(repair.SEGMENT, repair.BATCH), (3, 3000)])
def test_repair(spark, segment, batch):
    rows = broken(11)
    df = table(spark, rows)
    audits = repair.audited(df, segment=segment, batch=batch).cache()
    got = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    turns = repair.repaired(df, audits)
    shas = {r[0]: r[1] for r in repair.digests(turns).collect()}
    digest = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
    filled = [(c, (t, " " if r is None else r, " " if x is None else x)) for c, t, r, x in rows]
    for c, own in grouped(filled, lambda r: (-1 if r[1][0] is None else r[1][0], r[1][1], digest(r[1]))).items():
        want = brute([r for _, r in own])
        assert (*got.pop(c), shas.get(c, sha(""))) == want
    assert not got
    for c, out in grouped(turns.collect(), lambda r: r.place).items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in out)), c
    assert repair.audited(df.limit(0)).count() == 0


def test_op12_of_conversations_without_rows(spark, tmp_path):
    """Conversations of which the damage leaves nothing, and null keys."""
    table(spark, [(i, 0, "user", f"{i}.") for i in range(60)] + [(None, 0, None, None), (None, None, "user", "a.")]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {None, *range(60)}
    gone = [r for r in got.values() if r.audit == ""]
    assert gone and all((r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.repaired_sha256) == (0, 0, 0, 0, 0, 0, sha("")) for r in gone)


def test_moves_are_by_rule():
    assert len(repair.moves()) == len(set(repair.moves()))
    assert ("u", 0, 2, 0, "K") in repair.moves() and ("U", 2, 2, 6, "IK") in repair.moves() and ("s", 0, 1, 0, "K") in repair.moves()
    assert all(m[4].endswith("D") for m in repair.moves() if m[0] == "D")
