"""Conversation trie, language identification and structure repair against brute force, SQL and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import conversation_repair, conversation_trie, language_id
from tallyloom.llm.conversation_sql import REPAIR_SQL, TRIE_SQL

ROLES = ["user", "assistant", "system", None, "", "tool", "user", "assistant", "unknown", "User"]
TEXTS = [None, "", " \t\n", "a", "a.", "b c!", "Was? ", "é ü. ", "x\x0by", "...", "?\n\n", "a", "a."]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, audit double, prefixes int")


def random_rows(seed, ids, longest=9):
    r = random.Random(seed)
    out = []
    for c in ids:
        turns = list(range(r.randint(1, longest)))
        turns = [t + r.choice([0, 0, 0, 5]) for t in turns]
        if r.random() < 0.2:
            turns[0] = None
        shared = r.random() < 0.5
        for k, t in enumerate(turns):
            role, text = (ROLES[k % 2], TEXTS[3 + k % 3]) if shared and k < 4 else (r.choice(ROLES), r.choice(TEXTS))
            out.append((c, t, role, text, "x", 1.0, 2))
        if r.random() < 0.3:
            out.append(out[-1])
    r.shuffle(out)
    return out


def in_order(rows):
    """{conv_id: rows in order}."""
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append((t, role, text))
    return by


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_trie(rows):
    by = {
        c: [(r or "", x or "") for t, r, x in sorted(v, key=lambda q: (q[0] is not None, q[0] or 0, q[1] or "", md5(q[2] or "")))]
        for c, v in in_order(rows).items() if c is not None
    }
    members = defaultdict(list)
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = by.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq) == d))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c, e in m if e))
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), parent, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, seed):
    rows = random_rows(seed, [*range(60), *range(100, 130), 200, 205, 219, -5, -20, 10**15, None])
    # copies, a deep shared path, and conversations left without turns
    rows += [(c, t, "user", "same", "x", 1.0, 2) for c in range(300, 312) for t in range(3)]
    rows += [(400 + k, t, "user", str(t), "x", 1.0, 2) for k in range(8) for t in range(5 * k + 1)]
    given = conversations(spark, rows)
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    monkeypatch.setattr(conversation_trie, "BATCH_TURNS", 40)
    monkeypatch.setattr(conversation_trie, "MOST_TURNS", 50)
    out = sorted((tuple(r) for r in conversation_trie.prefix_trie(given).select(*TRIE_COLUMNS).collect()), key=str)
    assert out == plain_trie(rows)
    given.write.parquet(f"{tmp_path}/conversations.parquet")
    view = duckdb.connect()
    view.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = view.execute(f"SELECT {', '.join(TRIE_COLUMNS)} FROM ({TRIE_SQL})").fetchall()
    assert sorted(found, key=str) == out


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(conversations(spark, [])).count() == 0
    one = conversation_trie.prefix_trie(conversations(spark, [(1, 0, "user", "a b", None, None, None)])).select(*TRIE_COLUMNS[:-1]).collect()
    h = zlib.crc32(b"1") % 4
    assert len(one) == (2 if h == 0 else 1) and one[0]["n_convs"] == 1


def test_fat_search_finds_every_exit():
    """Batches in any order give the trie of all prefixes; each search needs few look-ups."""
    r = random.Random(5)
    seqs = [[r.choice("ab") for _ in range(r.randint(0, 40))] for _ in range(150)]
    seqs += [s[: r.randint(0, len(s))] + [r.choice("abc")] for s in seqs]

    def path(i, s):
        prefixes = [conversation_trie.ROOT]
        for x in s:
            prefixes.append(hashlib.md5(prefixes[-1] + x.encode()).digest())
        return conversation_trie.Path(i, prefixes, [1] * len(s))

    trie = conversation_trie.ZFastTrie()
    for at in range(0, len(seqs), 37):
        trie.insert([path(i, s) for i, s in enumerate(seqs)][at : at + 37])
    rows = list(trie.expand())
    assert len(rows) == len({x[0] for x in rows}) == len({tuple(s[:d]) for s in seqs for d in range(len(s) + 1)})
    for i, s in enumerate(seqs):
        passed, _, depth = trie.locate(path(i, s))
        assert depth == len(s) and passed.extent <= len(s)
    assert conversation_trie.two_fattest(0, 7) == 4 and conversation_trie.two_fattest(4, 7) == 6 and conversation_trie.two_fattest(6, 7) == 7


def edits(facts, text):
    """All (cost, audit, repaired) of at most one insertion a gap, by trying everything."""
    out = []
    for gaps in itertools.product((None, "user", "assistant"), repeat=len(facts) + 1):
        for acts in itertools.product("DKuA", repeat=len(facts)):
            cost, audit, said = 0, "", []
            for k in range(len(facts) + 1):
                if gaps[k]:
                    cost, audit = cost + 3, audit + "I"
                    said.append((gaps[k], ""))
                if k < len(facts):
                    (role, must, cut), act = facts[k], acts[k]
                    if must and act != "D":
                        break
                    cost += {"D": 4, "K": 0}.get(act, 3) + (3 if cut and act != "D" else 0)
                    audit += act if act in "DK" else "R"
                    if act != "D":
                        said.append((role if act == "K" else {"u": "user", "A": "assistant"}[act], text[k]))
            else:
                if re.fullmatch("(s?(ua)+)?", "".join((r or "-")[:1] for r, _ in said)):
                    out.append((cost, audit, "\n".join(f"{r}:{x}" for r, x in said)))
    return min(out)


def plain_repair(rows):
    out = []
    for c, v in in_order(rows).items():
        s = lambda x: " " if x is None else x
        told = []
        for t, role, text in sorted(v, key=lambda q: (q[0] is not None, q[0] or 0, s(q[1]), md5(s(q[2])))):
            role, text = s(role), s(text)
            k = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
            if k:
                now = (t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
                told += [now] * (2 if k == 3 else 1)
        seen, n, facts = set(), [0, 0, 0], []
        for _, role, text in told:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                n[fault] += 1
            facts.append((role, fault < 2, fault == 2))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(facts))
        turns = {t for t, *_ in told if t is not None}
        cost, audit, said = edits(facts, [x for *_, x in told])
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repair_equals_brute_force(spark, tmp_path):
    rows = random_rows(3, [*range(150), None], longest=3)
    rows += [(1000 + k, 0, role, "x.", "x", 1.0, 2) for k, role in enumerate(ROLES)]
    names = [x.split()[0] for x in conversation_repair.OUT.split(", ")]
    given = conversations(spark, rows)
    out = sorted((tuple(r) for r in conversation_repair.repair(conversation_repair.damage(given)).select(*names).collect()), key=str)
    assert out == plain_repair(rows)
    given.write.parquet(f"{tmp_path}/conversations.parquet")
    view = duckdb.connect()
    view.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(view.execute(f"SELECT {', '.join(names)} FROM ({REPAIR_SQL})").fetchall(), key=str) == out


def test_repair_of_long_conversations_equals_sql(spark, tmp_path):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", " ", f"{t}!"]), "x", 1.0, 2) for c in range(3) for t in range(120)]
    names = [x.split()[0] for x in conversation_repair.OUT.split(", ")]
    given = conversations(spark, rows)
    out = sorted((tuple(r) for r in conversation_repair.repair(conversation_repair.damage(given)).select(*names).collect()), key=str)
    given.write.parquet(f"{tmp_path}/conversations.parquet")
    view = duckdb.connect()
    view.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(view.execute(f"SELECT {', '.join(names)} FROM ({REPAIR_SQL})").fetchall(), key=str) == out
    assert conversation_repair.repair(conversation_repair.damage(conversations(spark, []))).count() == 0


def test_cheapest_edits():
    assert conversation_repair.cheapest([]) == (0, "")
    assert conversation_repair.cheapest([("s", False, False)]) == (4, "D")
    assert conversation_repair.cheapest([("u", False, False), ("u", False, False)]) == (3, "KR")
    assert conversation_repair.cheapest([("u", False, False)]) == (3, "KI")
    assert conversation_repair.cheapest([("u", True, False), ("u", False, True), ("a", False, False)]) == (7, "DKK")


def plain_vector(text):
    kept = re.sub(r"[^\w]|[\d_]", " ", text.lower())
    s = " " + " ".join("".join(ch if ch.isalpha() else " " for ch in kept).split()) + " "
    letter = {c: np.random.Generator(np.random.Philox(key=ord(c))).integers(0, 2, language_id.DIMENSIONS, np.int8).astype(int) * 2 - 1 for c in set(s)}
    return sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(s, s[1:], s[2:], strict=False))


def test_language_id_equals_plain_vectors(spark):
    base = {"en": "the other that thing", "de": "der und ich schön", "el": "και το ένα ἄλλο"}
    rows = [(i, f"{base[x]} {x * (i % 5 + 1)} {i}!", x, 1.0) for i, x in enumerate(itertools.islice(itertools.cycle(base), 90))]
    rows += [(900, None, "en", 1.0), (901, "12 -- 3", "de", 1.0), (902, "", None, 1.0), (None, "the other", "en", 1.0), (903, "a", None, 1.0), (904, "the that " * 60_000, None, 1.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    names, prototypes = language_id.learn(docs)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    plain = {}
    for i, text, lang, _ in dict.fromkeys(rows):
        if lang and text and not held(i) and re.search(r"[^\W\d_]", text):
            v = plain_vector(text)
            plain[lang] = plain.get(lang, 0) + v / np.linalg.norm(v)
    assert names == sorted(plain)
    for x, p in zip(names, prototypes, strict=True):
        assert np.allclose(p, plain[x] / np.linalg.norm(plain[x]), atol=1e-4)
    for r in language_id.predict(docs, names, prototypes).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(r["text"]) < 1000:
            v = plain_vector(r["text"])
            cos = {x: float(v @ plain[x] / np.linalg.norm(v) / np.linalg.norm(plain[x])) for x in names}
            best = max(cos, key=cos.get)
            assert r["lang_pred"] == best and abs(r["score"] - max(0, cos[best])) < 1e-4
    empty = language_id.learn(docs.where("false"))
    assert empty[0] == [] and {x["lang_pred"] for x in language_id.predict(docs, *empty).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), names, prototypes).count() == 0


def test_language_sample_serves_every_language(spark):
    rows = [(i, f"wort {i % 7} abc", "de") for i in range(200)] + [(1000 + i, "mot éé", "fr") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.learn(docs, 10)[0] == ["de", "fr"]
    shares = dict(language_id._shares([("a", 100), ("b", 2), ("c", 1000)], 42))
    assert shares["b"] == 1 and shares["a"] * 100 == shares["c"] * 1000 == 20


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op12_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert held["n"] > 150 and held["a"] > 0.97
