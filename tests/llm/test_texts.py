"""The operators on documents against brute force, on a small table with awkward cases, and on an empty one."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import decontaminate, packing, pii, similarity_join, substring_dedup, token_counts, token_files, tokenizing
from gridloom.llm.shared import Words, scratch_path, text_bytes, word_set
from gridloom.llm.tokenizing import tokenizer_path
from tests.llm import data

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return data.frame(spark)


@pytest.fixture(scope="module")
def none(spark):
    return data.frame(spark, [])


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def plain(rows):
    return [(i, t or "") for i, t in rows]


def test_words_are_split_as_bytes_are():
    rows = ["a\tb \x0b c", "", " ", "x", "d e\x0cf", "é日本 ß"]
    w = Words(*text_bytes(pa.array(rows)))
    assert [[bytes(w.raw[w.start[i] : w.end[i]]) for i in range(w.first[r], w.first[r + 1])] for r in range(len(rows))] == [t.encode().split() for t in rows]
    again = Words(*text_bytes(pa.array(["zz", *rows])[1:]))
    assert (again.code == w.code).all()


def test_words_have_codes_of_their_own():
    """No structure of a word's letters cancels out: Thue and Morse's words, which polynomial hashes confuse; and words of
    every length, with letters of zero bytes."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    words = [word, word.translate(str.maketrans("ab", "ba")), *("x" * n for n in range(1, 60)), *("\0" * n for n in range(1, 20)), *("y" * n for n in (4095, 4096, 4097, 9000))]
    w = Words(*text_bytes(pa.array([" ".join(words)])))
    assert len(set(w.code.tolist())) == len(words)
    text, at = w.spelled()
    assert [text[a : b - 1].decode() for a, b in zip(at, at[1:])] == words


# ---- 1: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, tmp_path):
    import random

    r = random.Random(3)
    letters = [*"0123456789" * 2, *"..@@++--  ()aZé日_%x,", "\U0001f600", "a@b.cd", "1.2.3.4", "4539578763621486", "+1 (204) 555-0123"]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(60)))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, "1" * 3000), (703, "1 " * 4000), (704, "a" * 3000 + "@b"), (705, "a@b.c_d@e.f 300.1.2.3.4 1.2.3.4.5.6.7.8"), (706, "write bob [at] example [dot] com or call (913) 555-3797"), (706, None)]
    rows += [(1000 + i, f"mail ann.{i}@mail.example.com and {i % 200}.8.3.9 or call +1 (204) 555-0{100 + i} today") for i in range(100)]
    got = pii.op1_pii(spark, data.save(spark, tmp_path / "t", rows)).collect()
    assert len(got) == len(rows)
    of = dict(rows)
    for x in got:
        if x.doc_id == 706:
            continue
        want = base_spans(of[x.doc_id] or "")
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS], of[x.doc_id]
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, x.spans.split(",")))


def test_pii_adds_spans(spark, tmp_path):
    """Looser spans join where the labelers' votes speak for them; a failed check digit speaks against."""
    rows = [(1, "write bob [at] example [dot] com or call (913) 555-3797 now")]
    rows += [(i, f"er the ann.{i % 7}@mail.example.com of 10.{i % 200}.3.9 and 4539578763621486 x +1 (204) 555-0{i % 900 + 100} and 4539578763621487 is") for i in range(2, 300)]
    got = {x.doc_id: x for x in pii.op1_pii(spark, data.save(spark, tmp_path / "t", rows)).collect()}
    assert got[1].spans == "email:6:32,phone:41:55" and got[1].n_email == got[1].n_phone == 0
    assert got[2].spans == ",".join(base_spans(rows[1][1]))


def test_pii_of_many_spans(spark, tmp_path):
    """Spans are placed, parted and cut out in about linear time."""
    text = " ".join(f"é a{i}@b{i}.com 10.0.{i % 250}.3 x[at]y[dot]com" for i in range(25_000))
    row = pii.op1_pii(spark, data.save(spark, tmp_path / "t", [(1, text)])).collect()[0]
    want = base_spans(text)
    assert len(want) == 50_000 and (row.n_email, row.n_ip) == (25_000, 25_000)
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    out = pii.without(data.frame(spark, [(1, text)])).collect()[0].text
    assert out.count("<EMAIL>") >= 25_000 and out.count("<IP>") == 25_000 and "@" not in out and out.startswith("é <EMAIL> <IP> ")


def test_em_by_loops():
    """The labelers' reliabilities against a plain computation over single rows."""
    import math
    import random

    r = random.Random(6)
    rows = []
    for _ in range(400):
        true = r.random() < 0.6
        rows.append((r.randrange(2), *(r.choice([0, 1 if r.random() < (0.9 if true else 0.2) else -1]) for _ in range(5)), 0, 0, 0, 0))
    got, post = pii.em(Counter(rows))
    p = [0.95 if x[1] == 1 else 0.5 if x[1] == 0 and sum(x[1:6]) > 1 else 0.05 for x in rows]
    for _ in range(pii.ROUNDS):
        prior = {k: (sum(q for x, q in zip(rows, p) if x[0] == k) + 1) / (sum(x[0] == k for x in rows) + 2) for k in {x[0] for x in rows}}
        chance = {}
        for t in (0, 1):
            for i in range(5):
                mass = {v: sum(q if t else 1 - q for x, q in zip(rows, p) if x[1 + i] == v) + (4 if v == (1 if t else -1) else 1) for v in (-1, 1)}
                for v in (-1, 1):
                    chance[t, i, v] = mass[v] / (mass[-1] + mass[1])
        odds = [prior[x[0]] / (1 - prior[x[0]]) * math.prod(chance[1, i, v] / chance[0, i, v] for i, v in enumerate(x[1:6]) if v) for x in rows]
        p = [o / (1 + o) for o in odds]
    assert all(abs(got["prior"][k] - v) < 1e-3 for k, v in prior.items()) and all(abs(got["chance"][k] - v) < 1e-3 for k, v in chance.items())
    assert all(abs(post[x] - q) < 1e-3 for x, q in zip(rows, p))


def test_pii_redaction(spark, docs, none):
    df = data.frame(spark, [(1, "é mail a@b.cd now"), (2, None), (3, ""), (4, "clean")])
    out = {r.doc_id: r for r in pii.without(df).collect()}
    assert out[1].text == "é mail <EMAIL> now" and out[1].n_chars == len(out[1].text) and out[2].text is None and out[4].text == "clean"
    assert pii.without(none).count() == 0 and pii.without(df).columns == df.columns
    assert pii.detect(none).count() == 0


# ---- 2: substring dedup


def test_substring_dedup(spark, docs, none):
    rows = plain(data.texts())
    count = Counter(tuple(w[j : j + 35]) for _, t in rows for w in [t.encode().split()] for j in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = t.encode().split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = True
        want.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 500
    assert substring_dedup.remove_repeats(none).count() == 0


def test_alike_hashes_remove_nothing(spark):
    """Windows that differ in one word only, of which the one's letters are the other's exchanged, stay."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    common = data.words(70, 34)
    rows = [(1, f"{common} {word}"), (2, f"{common} {word.translate(str.maketrans('ab', 'ba'))}"), (3, f"{common} other")]
    got = substring_dedup.remove_repeats(data.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 35, 0), (2, 35, 0), (3, 35, 0)]


def test_paths_that_branch_and_very_long_texts(spark):
    """Copies of passages inside each other, a passage that goes on in two ways, a period, and a text of 60,000 words."""
    long = data.words(71, 60_000, 10**6).split(" ")
    a, b, c = (data.words(72 + i, 90, 10**6).split(" ") for i in range(3))
    lists = [long, long[100:300], long[250:50_000] + a, a + b, a + c, b[:50] + c[:60], ["la", "lo"] * 60, c]
    rows = [(i, " ".join(w)) for i, w in enumerate(lists)]
    count = Counter(tuple(w[j : j + 35]) for w in lists for j in range(len(w) - 34))
    want = []
    for i, w in enumerate(lists):
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = True
        want.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    assert sorted(map(tuple, substring_dedup.remove_repeats(data.frame(spark, rows)).collect())) == want


def test_registered_dedups_match_their_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for run, sql, names in ((substring_dedup.op2_substring_dedup, substring_dedup.SQL, ("doc_id", "n_words", "n_removed", "kept_sha256")), (similarity_join.op5_jaccard_join, similarity_join.SQL, ("doc_id", "class_id", "links"))):
        got = sorted(map(tuple, run(spark, folder).select(*names).collect()))
        assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())


# ---- 4: decontamination


def test_decontamination(spark, docs, none):
    passage = data.words(2, 60)
    near = passage.upper().split(" ")
    near[30] = "other"
    items = spark.createDataFrame([(1, passage), (2, " ".join(near)), (3, data.words(900, 40)), (4, None), (5, ""), (6, "a b c d"), (7, "one")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.find_contaminated(docs, items).collect()), key=repr)
    want = []
    for i, t in plain(data.texts()):
        have = word_set(t.lower())
        for item, text in ((r.item_id, r.text) for r in items.collect()):
            s = word_set((text or "").lower())
            if s and len(s & have) * 5 >= len(s) * 4:
                want.append((i, item, len(s), len(s & have)))
    assert got == sorted(want, key=repr) and {w[1] for w in want} == {1, 2, 6, 7}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {w[0] for w in want}
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == sorted((i for i, _ in data.texts() if i not in bad), key=repr)
    assert decontaminate.find_contaminated(none, items).count() == 0 and decontaminate.find_contaminated(docs, items.limit(0)).count() == 0


# ---- 5: similarity join


def groups(rows):
    sets = [word_set(t) for _, t in rows]
    meet = defaultdict(int)
    where = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            for m in where[x]:
                meet[m, n] += 1
            where[x].append(n)
    links, top = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), both in meet.items():
        if both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4:
            links[a] += 1
            links[b] += 1
            top[find(b)] = find(a)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)].append(i)
    return sorted(((i, min(least[find(n)], default=i), links[n]) for n, (i, _) in enumerate(rows)), key=repr)


def test_similarity_join(spark, docs, none):
    rows = plain(data.texts())
    assert sorted(map(tuple, similarity_join.join(docs).collect()), key=repr) == groups(rows)
    kept = similarity_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == len({c for i, c, _ in groups(rows)})
    assert similarity_join.join(none).count() == 0 and similarity_join.one_of_each(none).count() == 0


def test_large_groups_are_joined_in_blocks(spark, monkeypatch):
    import random

    r = random.Random(4)
    base = data.words(50, 150).split(" ")
    rows = []
    for i in range(90):  # near copies, more than a bucket holds, sharing a hot line with unlike texts
        w = list(base)
        w[r.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:8]) + " " + data.words(300 + i, 60)) for i in range(80)] + [(400, rows[0][1])] * 3
    monkeypatch.setattr(similarity_join, "BUCKET", 16)
    monkeypatch.setattr(similarity_join, "BLOCK", 20)
    assert sorted(map(tuple, similarity_join.join(data.frame(spark, rows)).collect()), key=repr) == groups(rows)


def test_every_link_of_a_cloud_is_found(spark):
    """The shipped constants on a group beyond a bucket's size whose members are from 0.3 to 1 alike, on texts that share
    one line, and on pairs at the threshold, against brute force."""
    import random

    r = random.Random(11)
    base = data.words(60, 120).split(" ")
    rows = [(i, " ".join(w if r.random() > 0.03 * (i % 5) else f"n{i}-{j}" for j, w in enumerate(base))) for i in range(150)]
    rows += [(500 + i, " ".join(base[:7]) + " " + data.words(400 + i, 60, 10**6)) for i in range(120)]
    for g in range(20):  # 80 of 100 shingles: exactly 4/5
        w = data.words(600 + g, 104, 10**6).split(" ")
        rows += [(1000 + 2 * g, " ".join(w)), (1001 + 2 * g, " ".join(w[:84]))]
    want = groups(rows)
    assert sum(links for i, _, links in want if i >= 1000) == 40
    assert sorted(map(tuple, similarity_join.join(data.frame(spark, rows)).collect()), key=repr) == want


def test_runs_are_repeated_until_the_recall(spark, monkeypatch):
    """With runs that sample too little, further ones are added until the sample's links are found."""
    rows = [(2 * g + i, " ".join((data.words(650 + g, 60, 10**6).split(" "))[i:])) for g in range(60) for i in (0, 1)]
    asked, first = [], similarity_join.first_paths
    monkeypatch.setattr(similarity_join, "first_paths", lambda docs, n: asked.append(n) or first(docs, n))
    monkeypatch.setattr(similarity_join, "SAMPLED", 0.05)
    assert sorted(map(tuple, similarity_join.join(data.frame(spark, rows)).collect()), key=repr) == groups(rows)
    assert asked == list(range(len(asked))) and len(asked) > 1


SIZES = (299, 300, 301, 310)  # shingles


def test_near_copies_of_any_size_share_small_buckets(spark):
    rows = []
    for g in range(6):
        base = data.words(800 + g, 320).split(" ")
        rows += [(10 * g + i, " ".join(base[: n + 4])) for i, n in enumerate(SIZES)]
    rows += [(100 + i, data.words(850 + i, 304 + i)) for i in range(4)]
    assert [len(s) for s in similarity_join.sets_of(pa.array([t for _, t in rows[:4]]))] == list(SIZES)
    want = groups(rows)
    assert sum(links for _, _, links in want) == 6 * 4 * 3
    assert sorted(map(tuple, similarity_join.join(data.frame(spark, rows)).collect()), key=repr) == want


def test_near_copies_of_any_size_share_large_buckets(spark):
    base, rows = data.words(860, 320).split(" "), []
    for i in range(120):  # more than a bucket holds, on either side of 300 shingles
        w = base[: SIZES[i % 4] + 4]
        w[2 * i + 10] = f"new{i}"
        rows.append((i, " ".join(w)))
    assert 60 > similarity_join.BUCKET
    want = groups(rows)
    assert {(c, links) for _, c, links in want} == {(0, 119)}
    assert sorted(map(tuple, similarity_join.join(data.frame(spark, rows)).collect()), key=repr) == want


# ---- 7: token counts

MIXED = ["it's they'll 're x''s", "a  b\n\n c \t", "\n's 'S", "no-break line", "x<|endoftext|>y <|endoftext|>", "'ll've" * 40, "ab" * 900, " " * 700, "½ ² Ⅷ 日本語", "﻿\x1c ᠎"]


def test_token_counts(spark, docs, none):
    rows = plain(data.texts())
    got = token_counts.count_tokens(docs, BYTE).collect()
    want = sorted(((i, len(t.encode()), n := len(ids), n > 1024) for (i, t), ids in zip(rows, library(BYTE, [t for _, t in rows]))), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    counter = token_counts.Transducer(BYTE, token_counts.class_runs())
    assert counter.counts(*text_bytes(pa.array(MIXED))).tolist() == [len(x) for x in library(BYTE, MIXED)]
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_all_of_unicode_counts_as_the_library_counts():
    import random

    r = random.Random(12)
    near = [32, 10, 39, 0x41, 0xE9, 0x4E00, 0x30, 0x86F0, 0x11BC8, 9, 0xA0, 0x2028]

    def letter():
        c = r.randrange(0x110000) if r.random() < 0.5 else r.choice(near)
        return chr(c) if not 0xD800 <= c < 0xE000 else " "

    texts = ["\U00011bc8\u86f0", *("".join(letter() for _ in range(r.randrange(60))) for _ in range(1500))]
    want = [len(x) for x in library(BYTE, texts)]
    assert token_counts.Transducer(BYTE, token_counts.class_runs()).counts(*text_bytes(pa.array(texts))).tolist() == want
    rank = tokenizing.RankEncoder(BYTE)
    assert [len(rank.one(t)) for t in texts] == want


def test_long_texts_without_a_mark():
    import random
    import time

    r = random.Random(13)
    counter, rank = token_counts.Transducer(BYTE, token_counts.class_runs()), tokenizing.RankEncoder(BYTE)
    for text, seconds in ((" " * 2_000_000 + "w", 3), ("abcdefghij" * 100_000, 3), ("".join(r.choice("abcdef") for _ in range(50_000)), 60)):
        began = time.time()
        got = counter.counts(*text_bytes(pa.array([text])))[0]
        assert time.time() - began < seconds
        assert got == len(rank.one(text)) == len(library(BYTE, [text])[0])


def test_transducer_starts_over(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    counter = token_counts.Transducer(BYTE, token_counts.class_runs())
    texts = [data.words(i, 40) for i in range(30)]
    for t in texts:
        assert counter.counts(*text_bytes(pa.array([t])))[0] == len(library(BYTE, [t])[0])


# ---- 8: token files


def test_token_files(spark, docs, none):
    rows = sorted(plain(data.texts()), key=lambda r: (-1 if r[0] is None else r[0], r[1].encode()))
    ids = [[*x, 1] for x in library(WORD, [t for _, t in rows])]
    starts = np.cumsum([0, *map(len, ids)])
    want = [(i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids)]
    folder = scratch_path(spark, "test")
    shards = token_files.write(docs, folder, WORD)
    assert sorted(map(tuple, token_files.read(shards).collect()), key=lambda r: r[1]) == want
    whole = np.concatenate([np.fromfile(r.path.removeprefix("file://") + ".ids", r.dtype) for r in shards.orderBy("base").collect()])
    assert whole.tolist() == [x for d in ids for x in d]  # the exact round trip
    assert token_files.read(token_files.write(none, folder + "-none", WORD)).count() == 0


def test_equal_ids_have_one_order(spark):
    """Rows of one id with different texts, over several shards: by the text's hash, then the text."""
    rows = [(5, data.words(i, 20 + i)) for i in range(60)] + [(4, "x"), (6, None), (6, "")]
    docs = data.frame(spark, rows)
    ordered = [r.text or "" for r in docs.selectExpr("doc_id", "coalesce(text, '') AS text").selectExpr("*", "xxhash64(text) AS h").orderBy("doc_id", "h", "text").collect()]
    shards = token_files.write(docs, scratch_path(spark, "ties"), WORD)
    assert shards.count() > 1
    got = sorted(token_files.read(shards).collect(), key=lambda r: r.start)
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for x in library(WORD, ordered)]


def test_the_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_WORDS", 10)
    e = tokenizing.Encoder(WORD)
    text = " ".join(f"w{i}" for i in range(300)) + " " + "z" * 500
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.many([text, text])] == library(WORD, [text, text])
    assert len(e.kept) <= 10 and len(e.kept.elder) <= 10 and "z" * 500 not in e.kept


def test_encoders_equal_the_library():
    mixed = [*MIXED, "HELLO don't STOP İstanbul Σίσυφος é É", "<|startoftext|> a<|endoftext|>", "a1b2 !!! ,.", "\x00 \x7f x"]
    for path in (WORD, BYTE):
        e = tokenizing.Encoder(path)
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.many(mixed)] == library(path, mixed)
    e = tokenizing.RankEncoder(BYTE)
    assert [e.one(t).tolist() for t in mixed] == library(BYTE, mixed)


# ---- 9: packing


def test_packing(spark, docs, none):
    got = packing.pack(docs, BYTE, width=256).collect()
    want = Counter()
    total = 0
    for (i, _), x in zip(data.texts(), library(BYTE, [t or "" for _, t in data.texts()])):
        x = np.array([*x, 0], "<u4")
        total += len(x)
        cuts = [0, *range(len(x) % 256 or 256, len(x) + 1, 256)]
        want.update((i, p, a, b - a, zlib.crc32(x[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(tuple(r)[:5] for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        assert sorted(places)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(places), sorted(places)[1:])) and sum(p[1] for p in places) <= 256
    assert len(used) <= -(-total // 256) + 2
    assert packing.pack(none, BYTE).count() == 0


def sequences(counts, width, runs):
    """The number of sequences, after a check that pieces lie in them without gaps or overlaps."""
    fill: dict[int, list] = defaultdict(list)
    for n, mine in runs.items():
        ends = [x[0] for x in mine[1:]] + [counts[n]]
        for (rank, first, each, offset), end in zip(mine, ends):
            for k in range(end - rank):
                fill[first + k // each].append((offset + k % each * n, n))
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= width
    assert sum(map(len, fill.values())) == sum(counts.values())
    return len(fill)


def best_fit_decreasing(counts, width):
    gaps: list[int] = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                gaps.append(width - n)
            else:
                gaps[gaps.index(fit)] -= n
    return len(gaps)


def test_supersteps_pack_as_best_fit_decreasing_does(spark, monkeypatch):
    import random

    r = random.Random(5)
    counts = {r.randrange(1, 257): r.randrange(1, 40) for _ in range(120)}
    on_spark = packing.match(spark, counts, 256)
    assert sequences(counts, 256, on_spark) <= best_fit_decreasing(counts, 256) + 1

    def superstep(_, runs, width, shortest):  # the same sweeps without jobs: three ranges, then across
        def sweep(rows):
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[x.split()[0] for x in packing.RUNS.split(", ")])
            return [row for b in packing._sweeps(width, shortest)([batch]) for row in zip(*(b.column(i).to_pylist() for i in range(7)))]

        near = [row for k in range(3) if (part := [x for x in runs if x[1] * 3 // (width + 1) == k]) for row in sweep(part)]
        return sweep(near)

    monkeypatch.setattr(packing, "superstep", superstep)
    for _ in range(60):
        width = r.choice([64, 200, 2048])
        counts = {r.randrange(1, width + 1): r.randrange(1, 60) for _ in range(r.randrange(1, 60))}
        best = best_fit_decreasing(counts, width)
        assert sequences(counts, width, packing.match(None, counts, width)) <= best + max(1, best // 100)


def test_packing_of_very_long_runs(spark):
    rows = [(1, " " * 2_000_000 + "w"), (2, "abcdefghij" * 100_000), (3, None)]
    got = packing.pack(data.frame(spark, rows), BYTE).collect()
    want = {i: len(x) + 1 for (i, _), x in zip(rows, library(BYTE, [t or "" for _, t in rows]))}
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert dict(total) == want and max(r.length for r in got) == 2048
