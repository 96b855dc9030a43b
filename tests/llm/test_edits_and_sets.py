"""Fill-in-the-middle, SuperMinHash groups and conversation repair against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sedimenta.llm import conversation_repair as repair
from sedimenta.llm import fill_in_middle as fim
from sedimenta.llm import linked_sets
from sedimenta.llm import super_minhash as minhash

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# fill in the middle

def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    key = "" if doc_id is None else doc_id
    h = [int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(p) for p in (units[:first], units[first:second], units[second:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(a), len(b), f"<P>{a}<S>{c}<M>{b}" if form == "psm" else f"<S>{c}<P>{a}<M>{b}"


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab <>PSM\n\té日\x0b\xa0") for _ in range(rng.randint(0, 15))) for _ in range(400)]
    return texts + [None, "", " ", "x", "a <P> b", "<S", "long wörd " * 30_000, "y" * 200_000]


def test_fill_in_middle(spark):
    rows = [*enumerate(odd_texts()), (None, "one two three"), (3, "again the same id"), (3, "again the same id")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id bigint, text string, output string, form string")
    got = sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.fill_in_middle(docs).collect())))
    assert got == sorted(str((i, *plain_fim(i, t))) for i, t in rows)
    back = fim.with_restored(fim.fill_in_middle(docs))
    assert sorted(r.restored for r in back.collect()) == sorted(t or "" for _, t in rows)
    assert {r.form for r in back.collect()} == {"plain", "psm", "spm"}
    assert fim.with_restored(fim.fill_in_middle(docs.limit(0))).collect() == []


def test_every_cut_of_every_form_is_undone():
    for text in odd_texts()[:120]:
        if text is None or any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        data = text.encode()
        ends = [0, *fim.unit_ends(np.frombuffer(data, np.uint8)).tolist()]
        assert ends[1:] == [len(text[:m.end()].encode()) for m in UNIT.finditer(text)]
        for i in ends:
            for j in (e for e in ends if e >= i):
                a, b, c = data[:i], data[i:j], data[j:]
                for form, want in (("psm", b"<P>" + a + b"<S>" + c + b"<M>" + b), ("spm", b"<S>" + c + b"<P>" + a + b"<M>" + b)):
                    assert fim.transformed(data, i, j, form) == want and fim.restored(want, form) == data


def test_fill_in_middle_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {r.doc_id: (*(p := plain_fim(r.doc_id, r.text))[:4], sha(p[4]), sha(r.text)) for r in docs}
    assert {r.doc_id: tuple(r)[1:] for r in fim.op11_fill_in_middle(spark, sf_dir).collect()} == want


# SuperMinHash

def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(tuple(words))


def plain_groups(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        least = min(ids, default=None) if sets[k] else i
        out.append((i, len(sets[k]), least, i == least))
    return sorted(map(str, out))


def one_signature(hashes):
    out = [None] * minhash.SLOTS
    for h in hashes:
        order = list(range(minhash.SLOTS))
        for j in range(minhash.SLOTS):
            drawn = int(minhash.mixed(np.array([h], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
            k = ((drawn & 0xFFFFFFFF) * (minhash.SLOTS - j) >> 32) + j
            order[j], order[k] = order[k], order[j]
            value = j << 32 | drawn >> 32
            if out[order[j]] is None or value < out[order[j]]:
                out[order[j]] = value
    return out


def test_signature_is_the_least_rank_of_whole_permutations():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 2, 3, 40, 300)]
    got = minhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert [g.tolist() for g in got] == [one_signature(s.tolist()) for s in sets]
    # a slot of one set is as likely the other's as they are similar, with less spread than independent minima
    shares = []
    for _ in range(60):
        base = rng.integers(0, 1 << 64, 100, np.uint64)
        x, y = minhash.signatures(np.r_[base[:90], base[10:]], np.array([90, 90]))
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.8) < 0.02 and np.std(shares) < (0.8 * 0.2 / minhash.SLOTS) ** 0.5


def test_parity_sketches_never_give_up_a_similar_pair():
    rng = np.random.default_rng(4)
    for n in (3, 60, 400, 3000):
        for shared in np.linspace(0.5, 1, 12):
            base = rng.integers(0, 1 << 64, 2 * n, np.uint64)
            k = int(n * shared)
            a, b = base[:n], base[n - k:2 * n - k]
            x, y = linked_sets.parity_sketch(a), linked_sets.parity_sketch(b)
            passed = linked_sets.may_be_similar(x, n, np.frombuffer(y, "<u8")[None, :], np.array([n]), 80)[0]
            if 100 * k >= 80 * (2 * n - k):
                assert passed
            elif n <= 400 and shared < 0.8:
                assert not passed


def set_rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = rng.sample(words, rng.choice([4, 12, 40, 120]))
        for _ in range(rng.randint(1, 7)):
            now = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                now[rng.randrange(len(now))] = rng.choice(words)
            rows.append((len(rows), " ".join(now)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "word"), (504, "WORD"), (505, "word word"), (506, "\xa0"), (507, "a b " * 40_000), (508, "A b"), (None, rows[0][1]), (None, "alone here")]
    return rows + [rows[3], rows[3], (7, "another text with id seven")]


@pytest.mark.parametrize("block, bits", [(1024, minhash.FILTER_BITS), (2, 1 << 15)])
def test_near_duplicate_sets(spark, monkeypatch, block, bits):
    monkeypatch.setattr(linked_sets, "BLOCK", block)
    rows = set_rows()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id bigint, text string, key bigint, kept string").repartition(5)
    got = minhash.near_duplicate_sets(docs, filter_bits=bits).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == plain_groups(rows)
    assert minhash.near_duplicate_sets(docs.limit(0)).collect() == []


def test_chain_of_near_copies(spark):
    """A long band whose members are not all similar to its least one: the rest is found among blocks."""
    rng = random.Random(2)
    now, rows = [f"w{k}" for k in range(60)], []
    for k in range(90):
        rows.append((k, " ".join(now)))
        now = list(now)
        now[rng.randrange(60)] = f"n{k}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(str, (tuple(r) for r in minhash.near_duplicate_sets(docs).collect()))) == plain_groups(rows)


def test_minhash_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = minhash.op12_minhash(spark, sf_dir).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == plain_groups(rows)
    assert any(not r.kept for r in got)


def test_shingles_of_short_texts():
    found, sizes = minhash.shingle_sets(pa.array(["A b c a B", "", "x", " \t", "a  b"]))
    assert sizes.tolist() == [3, 0, 1, 0, 1] and found[-1] in found[:3]


# conversation repair

NEXT = {"0": "U", "S": "U", "U": "A", "A": "U"}
KEPT = {("s", "0"): "S", ("u", "0"): "U", ("u", "S"): "U", ("u", "A"): "U", ("a", "U"): "A"}


def cheapest(symbols):
    """(cost, letters) by plain recursion over (initial, fault) rows, from the end."""
    none, after = (10**9, ""), None
    for i in range(len(symbols), -1, -1):
        now = {}
        for q in "0SUA":
            options = [none]
            if i == len(symbols):
                options += [(0, "")] if q in "0A" else []
            else:
                initial, fault = symbols[i]
                options.append((after[q][0] + 3, "D" + after[q][1]))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    if (kept := KEPT.get((initial, q))) is not None:
                        options.append((after[kept][0] + more, "K" + after[kept][1]))
                    options.append((after[NEXT[q]][0] + 2 + more, "R" + after[NEXT[q]][1]))
            now[q] = min(options)
        for _ in range(3):
            now = {q: min(v, (now[NEXT[q]][0] + 2, "I" + now[NEXT[q]][1])) for q, v in now.items()}
        after = now
    return after["0"]


def plain_repair(rows):
    found = {}
    text_of = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        out, role, text = found.setdefault(conv, []), text_of(role), text_of(text)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    result = {}
    for conv, out in found.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, symbols = set(), []
        for _, role, text in out:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            symbols.append((role[:1], fault))
        turns = {r[0] for r in out} - {None}
        cost, letters = cheapest(symbols)
        left, state, lines = iter(out), "0", []
        for letter in letters:
            if letter == "I":
                state = NEXT[state]
                lines.append("user:" if state == "U" else "assistant:")
                continue
            _, role, text = next(left)
            if letter == "K":
                state = KEPT[role[0], state]
                lines.append(f"{role}:{text}")
            elif letter == "R":
                state = NEXT[state]
                lines.append(("user:" if state == "U" else "assistant:") + text)
        faults = [f for _, f in symbols]
        result[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:])), cost, letters,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return result


def test_tables_give_the_cheapest_and_least_letters():
    rng, tables = random.Random(6), repair.blocks()
    for _ in range(1500):
        symbols = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 13))]
        coded = bytes(repair.symbol_of(*s) for s in symbols)
        _, _, front, cost = tables.ends(coded, 0)
        letters, _, state = tables.trace(coded, 0, repair.START)
        assert (cost + tables.vectors[front][repair.START], "".join(letters) + tables.tail(state)) == cheapest(symbols)


def damaged_rows():
    rng = random.Random(5)
    rows = []
    for conv, size in ((None, 30), (1, 3), (2, 45), (3, 2500), (4, 0), (5, 1)):
        for k in range(size):
            rows.append((conv, rng.choice([k, k, rng.randint(0, 3000)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([None, "", f"w{k}.", f"w{k}", f"w{k % 7}!", " \n", "é?\x0b"])))
    rows = [*{(r[0], r[1]): r for r in rows}.values(), (9, None, "user", "hi."), (9, None, "user", "hi."), (9, 7, None, None)]
    dropped = next(t for t in range(100) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    return [*rows, (8, dropped, "user", "gone."), (10, 4, "user", "x " * 300_000 + ".")]


@pytest.mark.parametrize("held_rows", [4096, 10, 1])
def test_conversation_repair(spark, held_rows):
    rows = damaged_rows()
    table = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, part int").repartition(3)
    parts = repair.repaired(repair.damaged(table), held_rows)
    assert {r.conv_id: tuple(r)[1:] for r in repair.digests(parts).collect()} == plain_repair(rows)
    assert repair.digests(repair.repaired(repair.damaged(table.limit(0)))).collect() == []


def test_conversation_repair_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, sf_dir).collect()} == plain_repair(rows)
