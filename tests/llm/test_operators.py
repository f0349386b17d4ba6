"""Brute-force, round-trip and edge-case tests of the text operators on small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlake.llm import ctw, decontam, langid, neardup, packing, pseudonyms, quality, queries, sharding, toxicity, warc
from cardlake.llm.components import components

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 4000


def split(text):
    return [w for w in BLANK.split(text or "") if w]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, repeated rows, a very long text, and columns named like results."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "one two three four five six"), (5, "one two three four five six"), (None, "no id here"), (7, "É ß 日本語 текст"), (8, LONG)]
    return spark.createDataFrame([(i, t, 1, "x", True, "en", 0) for i, t in rows], "doc_id long, text string, n_words int, score string, kept boolean, lang string, slot int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_base(docs):
    got = {r["doc_id"]: r for r in quality.features(docs).collect()}
    for r in docs.collect():
        ws = split(r["text"])
        runs = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        hit = {i + k for i in range(len(ws) - 7) if runs[tuple(ws[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in r["text"].split("\n") if split(x)]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_repeat_words"], g["n_dup_lines"]) == (len(ws), sum(map(len, ws)), len(hit), len(lines) - len(set(lines)))
        assert g["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"]))


def test_quality_model(spark, docs):
    measured = quality.features(docs)
    judged = quality.judge(measured, quality.fit(measured)).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id").filter("not base_failed")
    assert judged.select(F.avg((F.col("kept") == (F.col("label") == 1)).cast("int"))).first()[0] > 0.95


def test_quality_odd(odd):
    measured = quality.features(odd)
    out = quality.judge(measured, quality.fit(measured))
    assert out.count() == odd.count() and out.filter("n_words = 0 and kept").isEmpty()
    assert quality.filter_quality(odd.limit(0)).columns == odd.columns


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, docs, limit):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "The"), (901, None), (902, "of the")], "item_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for b in bench.collect():
        ws = word.findall((b["text"] or "").translate(LOW))
        for i in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[i : i + 13]), set()).add(str(b["item_id"]))
    sizes = {len(w) for w in windows}
    got = {r["doc_id"]: r for r in decontam.contamination(docs, bench, broadcast_windows=limit).collect()}
    for r in docs.collect():
        ws, hit, items = word.findall(r["text"].translate(LOW)), set(), set()
        for s in sizes:
            for i in range(len(ws) - s + 1):
                if found := windows.get(tuple(ws[i : i + s])):
                    hit.update(range(i, i + s))
                    items |= found
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["item_ids"], g["contaminated"]) == (len(ws), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(ws))


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination_with_colliding_ids_and_null_items(spark, limit):
    bench = spark.createDataFrame([(None, "two three four"), (7, "two three four"), (None, "six seven"), (None, "eight")], "item_id long, text string")
    rows = [(1, "one two three four five"), (1, "one two three four five"), (1, "other words"), (None, "two three four"), (2, "six seven"), (2, "nothing " * 50)]
    out = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, broadcast_windows=limit)
    got = collections.Counter((r["doc_id"], r["text"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in out.collect())
    assert got == collections.Counter([(1, rows[0][1], 3, ("7",), True)] * 2 + [(1, rows[2][1], 0, (), False), (None, rows[3][1], 3, ("7",), True), (2, "six seven", 2, (), True), (2, rows[5][1], 0, (), False)])


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "two three four"), (1, "two three four"), (2, None), (3, "")], "item_id long, text string")
    out = decontam.contamination(odd, bench).collect()
    assert len(out) == odd.count() and [r["n_hit"] for r in out if r["doc_id"] == 5] == [3, 3]
    assert decontam.contamination(odd, bench.limit(0)).filter("n_hit > 0").isEmpty()
    assert decontam.contamination(odd.limit(0), bench).isEmpty()


def test_sharding(docs, odd):
    p = sharding.shard(docs, cells=2).toPandas()
    by = p.groupby("shard")
    assert len(p) == docs.count() and (by["slot"].max() + 1 == by.size()).all() and (by["slot"].nunique() == by.size()).all()
    total = by["size"].sum()
    assert total.max() <= p["size"].sum() / 24 + p["size"].max()
    p = sharding.shard(odd, shards=3).toPandas()
    assert len(p) == odd.count() and p.loc[p.doc_id == 1, "size"].tolist() == [8]
    assert sharding.shard(odd.limit(0)).isEmpty()


def test_sharding_query_against_brute_force(spark, docs, monkeypatch):
    out = queries.op2_histogram_sharding(spark, SF).collect()
    texts = docs.select("doc_id", "text").collect()
    row = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == collections.Counter(row(r["doc_id"], r["text"]) for r in texts)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)} and {r["shard"] for r in out} <= set(range(24))
    total = sum(r["size"] for r in out)
    # one text is at most what a shard is off by, on either side
    sizes = collections.Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert all(abs(n - total / 24) <= 2 * max(r["size"] for r in out) for n in sizes.values())
    for k in range(24):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    where = collections.defaultdict(set)
    for r in out:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 23
    monkeypatch.setattr(sharding, "CELL_BYTES", 4096)  # many cells to a shard
    fine = sharding.shard(docs.select("doc_id", "text")).toPandas()
    by = fine.groupby("shard")
    assert len(fine) == len(out) and (by["slot"].max() + 1 == by.size()).all() and (by["slot"].nunique() == by.size()).all()


def test_packing(docs, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    for df in (docs, odd):
        want, lengths = collections.Counter(), {}
        for r in df.collect():
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
            want.update((r["doc_id"], k // 4, ids[k : k + 4], len(ids) // 4) for k in range(0, len(ids), 4))
        got, sequences = collections.Counter(), collections.defaultdict(list)
        for r in packing.pack(df).collect():
            ids = bytes(r["ids"])
            got.update((r["doc_id"], r["start"] + k // 4, ids[k : k + 4], r["doc_tokens"]) for k in range(0, len(ids), 4))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert got == want
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(odd.limit(0)).isEmpty()


def test_packing_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    r = np.random.default_rng(5)
    signs = [" ", "  ", "\n", "\t", "\xa0", "\u3000", "\x85", "\x1c", "\u200b", "a", "B", "17", "é", "'s", "'", ".", "<|endoftext|>", "中", "\u0301", "\r\n", "x" * 70]
    texts = ["".join(signs[k] for k in r.integers(0, len(signs), r.integers(0, 14))) for _ in range(20_000)]
    texts += [" " * 1_000_000 + "a", "\n " * 300_000, "x" * 100_000, LONG]
    encode = packing.Encoder(packing.default_tokenizer())
    assert encode.fast is not None
    assert encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_packing_balances_cost():
    r = np.random.default_rng(6)
    lengths = r.integers(1, 300, 600).tolist()  # documents that fill a sequence nearly leave no choice
    pieces = packing.balance(lengths)
    full = [p for p in pieces if sum(n for _, _, n in p) == 1024]
    cost = np.array([sum(packing.LINEAR * n + packing.QUADRATIC * n * n for _, _, n in p) for p in full])
    order, at, room = r.permutation(600), 0, 1024
    plain = [0.0]
    for d in order:  # the same documents one after the other
        left = lengths[d]
        while left:
            n = min(left, room)
            plain[-1] += packing.LINEAR * n + packing.QUADRATIC * n * n
            left, room = left - n, room - n
            if not room:
                plain, room = [*plain, 0.0], 1024
    assert cost.std() < 0.5 * np.std(plain[:-1])


def test_warc(spark, tmp_path):
    big, text = "<p>word</p>" * 200, "x" * 999
    rows = [(1, "u", big), (2, None, big), (3, "u", text), (4, "u", text), (5, "u", None), (6, "u", ""), (7, "u", big), (7, "u", big), (None, "u", "y")]
    rows += [(100 + i, f"http://h/{i}", f"<html>{i} {'ab ' * (i % 50)}</html>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    assert warc.write_archives(pages, folder, 4000).agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read_archives(spark, folder).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = max(first.get(html or "", -1), i)
    want = collections.Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = i is not None and len(raw) >= 1000 and first[html] != i
        want[(i, "revisit" if again else "response", first[html] if again else None, hashlib.sha1(raw).hexdigest(), len(raw))] += 1
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"]) for r in back) == want
    made = next(tmp_path.glob("archives/*.zst"))
    assert made.read_bytes()[:4] == b"\x5d\x2a\x4d\x18"
    (made.parent / "000000-lost-00007.warc.zst").write_bytes(made.read_bytes())  # what a lost attempt leaves
    assert warc.read_archives(spark, folder).count() == len(rows)


def test_warc_odd(spark, tmp_path):
    rows = [(1, "u\r\nX: 1", "<p>" + LONG * 20, "x", 7), (2, "u", "<p>" + LONG * 20, "x", 7), (None, None, None, None, None), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, refers_to long")
    folder = f"file://{tmp_path}/a"
    warc.write_archives(pages, folder)
    back = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, folder).collect())
    assert back == collections.Counter([(1, "revisit", 2, len(rows[0][2])), (2, "response", None, len(rows[1][2])), (None, "response", None, 0), (None, "response", None, 0)])
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").isEmpty()


def test_pseudonyms(spark, odd):
    key = "k"
    texts = ["mail a.b1@x.org card 4111 1111 1111 1111 no 4111 1111 1111 1112", "on 2001-02-28, 2001-02-30", "10.0.0.1 300.0.0.1", "078-05-1120 000-12-3456", "DE89 3704 0044 0532 0130 00", "call +1 (499) 555-6503", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(rows, key).collect()}
    assert [out[i]["n_pii"] for i in range(7)] == [2, 1, 1, 1, 1, 1, 0]
    assert "4111 1111 1111 1112" in out[0]["text"] and "2001-02-30" in out[1]["text"] and "300.0.0.1" in out[2]["text"]
    for i in range(6):
        assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", out[i]["text"])).count("0") >= 1 and out[i]["text"] != texts[i]
    card = re.search(r"card ([0-9 ]+) no", out[0]["text"]).group(1).replace(" ", "")
    assert sum(sum(divmod(int(c) * (1 + (k % 2)), 10)) for k, c in enumerate(reversed(card))) % 10 == 0
    iban = out[4]["text"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    # a permutation of the days, and of short strings
    days = spark.range(pseudonyms.DAYS[0] * pseudonyms.DAYS[1]).select(pseudonyms.permute_pair(key, "date", F.floor(F.col("id") / 4297), F.col("id") % 4297, 17, 4297).alias("p"))
    assert days.distinct().count() == 17 * 4297
    codes = spark.range(1000).select(pseudonyms.permute_characters(key, "card", F.lpad(F.col("id").cast("string"), 3, "0")).alias("c"))
    assert codes.distinct().count() == 1000
    assert pseudonyms.pseudonymise(odd, key).count() == odd.count() and pseudonyms.pseudonymise(odd.limit(0), key).isEmpty()


def test_pseudonyms_next_to_other_tokens(spark):
    iban, spaced, phone, date, card = "ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "+44 20 7946 0958", "2023-05-01", "4111 1111 1111 1111"
    texts = [iban, spaced, phone, date, card, f"{iban} EUR", f"{iban} 2024 x", f"{spaced} EUR", f"{phone} {date}", f"{phone} 15 x", f"{phone} 192.168.10.10", f"{date}T10:00:00Z", f"1234 {card}", f"{card} 2024", f"{phone}\n{card}", f"+49 30 12345 {date}", f"{date}Tx"]
    out = [(r["text"], r["n_pii"]) for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert [n for _, n in out] == [1, 1, 1, 1, 1, 1, 1, 1, 2, 1, 2, 1, 1, 1, 2, 2, 0]
    new = [t for t, _ in out]
    assert all(a != b for a, b in zip(texts[:5], new, strict=False))
    assert new[5:10] == [f"{new[0]} EUR", f"{new[0]} 2024 x", f"{new[1]} EUR", f"{new[2]} {new[3]}", f"{new[2]} 15 x"]
    assert new[10].startswith(f"{new[2]} ") and "192.168.10.10" not in new[10]
    assert new[11:15] == [f"{new[3]}T10:00:00Z", f"1234 {new[4]}", f"{new[4]} 2024", f"{new[2]}\n{new[4]}"] and new[15].endswith(f" {new[3]}") and new[16] == texts[16]


def feistel(key, kind, x, y, a, b):
    for r in range(pseudonyms.ROUNDS):
        below, other = (a, y) if r % 2 == 0 else (b, x)
        by = int(hashlib.sha256(f"{key}|{kind}|{r}|{other}".encode()).hexdigest()[:15], 16)
        x, y = ((x + by) % a, y) if r % 2 == 0 else (x, (y + by) % b)
    return x, y


def feistel_signs(key, kind, value):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for r in range(pseudonyms.ROUNDS):
        part, other = (left, right) if r % 2 == 0 else (right, left)
        h, out = hashlib.sha256(f"{key}|{kind}|{r}|{other}".encode()).hexdigest(), ""
        for i, c in enumerate(part):
            by = int(h[i % 16 * 4 :][:4], 16)
            low, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (ord(c), 1)
            out += chr(low + (ord(c) - low + by) % n)
        left, right = (out, right) if r % 2 == 0 else (left, out)
    return left + right


def test_networks_against_python(spark):
    pairs = spark.range(300).select(pseudonyms.permute_pair("k", "ip", F.col("id") % 13, F.col("id"), 13, 300).alias("p"), (F.col("id") % 13).alias("x"), "id").collect()
    assert all((r["p"]["x"], r["p"]["y"]) == feistel("k", "ip", r["x"], r["id"], 13, 300) for r in pairs)
    words = ["", "a", "Ab1", "a.b-C_9", "0000000000000000000000000000000000000000", "Zz@x"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", pseudonyms.permute_characters("k", "email", F.col("w")).alias("p")).collect()
    assert all(r["p"] == feistel_signs("k", "email", r["w"]) for r in rows)
    ip = spark.createDataFrame([(1, "at 10.20.30.40 or 010.1.1.1")], "doc_id long, text string")
    x, y = feistel("k", "ip", 10 * 256 + 20, 30 * 256 + 40, 65536, 65536)
    assert pseudonyms.pseudonymise(ip, "k").first()["text"] == f"at {x // 256}.{x % 256}.{y // 256}.{y % 256} or 010.1.1.1"


def test_dates_stay_apart_and_in_format(spark):
    import datetime

    days = [datetime.date(2003, 1, 1) + datetime.timedelta(k) for k in range(800)]
    texts = {f"{d:%d/%m/%Y}" for d in days} | {f"{d:%m/%d/%Y}" for d in days} | {f"{d.day}/{d.month}/{d.year}" for d in days} | {f"{d.day}.{d.month}.{d.year}" for d in days} | {f"{d:%d.%m.%Y}" for d in days} | {f"{d:%Y-%m-%d}" for d in days}
    rows = spark.createDataFrame([(t, t) for t in sorted(texts)], "old string, text string").repartition(8)
    out = pseudonyms.pseudonymise(rows, "k").collect()
    assert all(r["n_date"] == 1 for r in out) and len({r["text"] for r in out}) == len(texts)
    for r in out:
        old, new = (re.split("([./-])", r[c]) for c in ("old", "text"))
        assert [len(x) for x in old] == [len(x) for x in new] and old[1::2] == new[1::2]
        if "/" in r["old"]:
            assert [int(x) > 12 for x in old[:3:2]] == [int(x) > 12 for x in new[:3:2]]
        orders = ["%Y-%m-%d"] if "-" in r["old"] else ["%d.%m.%Y"] if "." in r["old"] else ["%d/%m/%Y", "%m/%d/%Y"]
        assert any(_is_date(r["text"], f) for f in orders)
    no = ["31.2.2001", "0/1/2001", "13/13/2001", "29/02/2001", "1/1/1899", "32.1.2000", "2001-13-01"]
    kept = pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in no], "text string"), "k").collect()
    assert {r["text"] for r in kept} == set(no)


def _is_date(text, form):
    import datetime

    try:
        return bool(datetime.datetime.strptime(text, form))
    except ValueError:
        return False


def test_secret_comes_from_the_session(spark):
    one = spark.newSession()
    one.conf.set(pseudonyms.SECRET, "mine")
    assert pseudonyms.session_key(one) == "mine"
    drawn = pseudonyms.session_key(spark.newSession())
    assert len(drawn) == 32 and drawn != pseudonyms.session_key(spark.newSession())


def bag(text):
    ws = split(text)
    return collections.Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else None


def brute_classes(rows):
    bags, root = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sorted(bags) if bags[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = sum((bags[i] & bags[j]).values())
            if shared >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - shared) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("unit", [3000, 7])
def test_near_duplicates(spark, monkeypatch, unit):
    r = np.random.default_rng(1)
    base = [[f"w{r.integers(0, 500)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for k in range(150):
        ws = list(base[k % 12 if k < 60 else 0])
        for _ in range(int(r.integers(0, 4))):
            ws[int(r.integers(0, len(ws)))] = f"v{r.integers(0, 10**6)}"
        rows.append((k, " ".join(ws)))
    rows += [(500, "a b"), (501, "a b"), (502, ""), (503, None), (504, "a a a a a a a a a a a a a"), (505, "a a a a a a a a a a a a a a a")]
    monkeypatch.setattr(neardup.units, "__defaults__", (unit,))
    monkeypatch.setattr(neardup.strays, "__defaults__", (unit,))
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_odd(odd):
    out = neardup.classes(odd).collect()
    assert len(out) == odd.count() and {r["class_id"] for r in out if r["doc_id"] == 8} == {4}
    kept = neardup.keep_one(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"] and kept.columns == odd.columns
    assert neardup.classes(odd.limit(0)).isEmpty()


def test_near_duplicates_with_colliding_ids(spark):
    other = [f"b{k}" for k in range(60)]
    near = [*other[:59], "new"]
    a, b, c, d, e = "the first text of all", " ".join(other), " ".join(near), "a text of its own", "rows without an id"
    rows = [(2, a), (5, a), (5, b), (5, d), (9, c), (5, d), (None, a), (None, e), (None, e), (7, ""), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["text"], r["class_id"]) for r in neardup.classes(df).collect())
    assert got == collections.Counter([(2, a, 2), (5, a, 2), (5, b, 5), (5, d, 5), (9, c, 5), (5, d, 5), (None, a, 2), (None, e, None), (None, e, None), (7, "", 7), (7, None, 7), (7, "", 7)])
    kept = collections.Counter((r["doc_id"], r["text"]) for r in neardup.keep_one(df).collect())
    assert kept == collections.Counter([(2, a), (5, b), (5, d), (None, e), (7, ""), (7, None)])


def test_signature_is_unbiased():
    r = np.random.default_rng(2)
    est, true = [], []
    for _ in range(60):
        a = np.sort(r.integers(0, 40, 90).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.sort(np.concatenate([a[:70], r.integers(0, 40, 20).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]))
        s = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
        est.append((s[0] == s[1]).mean())
        true.append(sum((ca & cb).values()) / sum((ca | cb).values()))
    assert abs(np.mean(est) - np.mean(true)) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_language(spark, docs, odd):
    p = queries.op4_hyperdimensional_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert p.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    out = langid.identify(odd, langid.learn(docs)).collect()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"} and len(out) == odd.count()
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(odd.limit(0))).collect()} == {"und"}


def test_bundles_against_definition(monkeypatch):
    """Vectors of texts equal sums over their n-grams, also where n-grams are taken a few at a time."""
    texts = ["Aab, ab c", "", "日本語 日本", "a1b22c", "zz"]
    letters = langid.Letters(64, 3)
    want = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        signs = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
        rows = [letters._vector(0x110000 if c == " " else ord(c)) for c in signs]
        for k in range(1, len(signs) - 1):
            if signs[k] != " ":
                want[i] += np.roll(rows[k - 1], 2) * np.roll(rows[k], 1) * rows[k + 1]
    for grams in (8192, 3):
        monkeypatch.setattr(langid, "GRAMS", grams)
        owner, gram, triples = letters.grams(texts)
        assert np.array_equal(letters.bundles(owner, gram, triples, len(texts)), want)


def test_bundles_memory_is_bounded():
    import tracemalloc

    r = np.random.default_rng(7)
    text = "".join(map(chr, r.integers(0x4E00, 0x9FA5, langid.SLICE // 3)))
    letters = langid.Letters()
    letters.rows(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    tracemalloc.start()
    owner, gram, triples = letters.grams([text])
    letters.bundles(owner, gram, triples, 1)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_language_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([("abc", "b"), ("abc", "a")], "text string, lang string")
    got = langid.identify(spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "abc")], "doc_id long, text string"), langid.learn(rows)).collect()
    assert [r["lang_pred"] for r in got] == ["a"] * 3
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), langid.learn(rows)).isEmpty()


def test_toxicity(spark, docs, odd):
    insults = ["idiot", "moron", "stupid", "loser"]
    r = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("ba", "ne", "to", "ri") for b in ("la", "mu", "so", "ke") for c in ("n", "r", "l", "s")]
    rows = [(i, " ".join(r.choice(words, 40)) + (f". {r.choice(words)} {insults[i % 4]} {insults[(i + 1) % 4]}." if i % 3 == 0 else "."), int(i % 3 == 0)) for i in range(400)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    trial = [(1, "bala neson idiot ba"), (2, "balan i d i o t neson toke"), (3, "balan i.d.i.o.t, mo-ron"), (4, "balan idxiot sttupid"), (5, "balan neson tokes rimul"), (6, None), (7, "")]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(spark.createDataFrame(trial, "doc_id long, text string"), model).collect()}
    assert min(got[k] for k in (1, 2, 3, 4)) > 2 * max(got[k] for k in (5, 6, 7))
    assert all(0 <= x["score"] <= 1 for x in toxicity.score(odd, model).collect())
    assert toxicity.score(odd, toxicity.Model()).filter("score <> 0").isEmpty()


def test_kernel_against_definition():
    """The kernel of two words is the cosine of their decayed counts of subsequences, and a basis of all words gives it back."""
    words = ["idiot", "idxiot", "a", "zz", "moron", "日本語日"]

    def counts(word):
        signs, out = toxicity.coded([word])[0].tolist(), collections.Counter()

        def walk(at, chosen):
            if len(chosen) == 3:
                out[tuple(signs[i] for i in chosen)] += toxicity.DECAY ** (chosen[-1] - chosen[0] + 1)
                return
            for i in range(at, len(signs)):
                walk(i + 1, [*chosen, i])

        walk(0, [])
        return out

    def phi(word):
        size = sum(v * v for v in counts(word).values()) ** 0.5
        return {k: v / size for k, v in counts(word).items()}

    want = [[sum(v * phi(b).get(k, 0) for k, v in phi(a).items()) for b in words] for a in words]
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-6)
    assert all(np.allclose(toxicity.norms(toxicity.coded([w])) ** 2, sum(v * v for v in counts(w).values())) for w in words)
    x = toxicity.Basis(words)(words)
    assert np.allclose(x @ x.T, want, atol=1e-4)


def test_toxicity_of_short_and_long_tokens(spark):
    r = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in ("ba", "ne", "to", "ri") for b in ("la", "mu", "so", "ke") for c in ("n", "r", "l", "s")]
    insults = ["xq", "vollpfostengesicht", "你这个没用的东西真是太让人讨厌了快滚开吧"]
    rows = [(i, " ".join(r.choice(words, 30)) + (f" {insults[i // 3 % 3]}" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    trial = [(k, f"balan neson {w}") for k, w in enumerate([*insults, "tokes", "rimul"])]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(spark.createDataFrame(trial, "doc_id long, text string"), model).collect()}
    assert min(got[k] for k in range(3)) > 2 * max(got[k] for k in (3, 4))


def test_language_model(spark, docs):
    out = {r["doc_id"]: r for r in ctw.scored(docs.select("doc_id", "text")).collect()}
    toks = {r["doc_id"]: [*split(r["text"].translate(LOW)), None] for r in docs.collect()}
    c = collections.Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = out[i]
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)


@pytest.mark.parametrize("depth, model_bytes", [(2, ctw.MODEL_BYTES), (4, ctw.MODEL_BYTES), (5, 80)])
def test_tree_weighting_against_definition(spark, depth, model_bytes):
    """Scores equal those of the recursive definition, for trees of several levels and for a table in several slices."""
    import functools

    train, new = ["abab abba", "bab", "abab"], ["abab", "xab b", "", "ba\u00e9", "abab abba"]
    path, slices = ctw.train(spark.createDataFrame([(t,) for t in train], "text string"), depth, model_bytes)
    assert (slices > 1) == (model_bytes < ctw.MODEL_BYTES)
    edge = b"\xff" * depth
    seen = []
    for t in train:
        raw = edge + t.encode() + b"\xff"
        seen += [(raw[i - depth : i][::-1], raw[i]) for i in range(depth, len(raw))]  # context, latest first

    @functools.cache
    def counts(ctx, node):
        return [sum(1 for c, b in seen if c.startswith(ctx) and f"{b:08b}".startswith(node + x)) for x in "01"]

    def pe(ctx, node):
        a, p = counts(ctx, node), 1.0
        for k in range(a[0]):
            p *= (k + 0.5) / (k + 1)
        for k in range(a[1]):
            p *= (k + 0.5) / (a[0] + k + 1)
        return p

    @functools.cache
    def pw(ctx, node):
        if len(ctx) == depth:
            return pe(ctx, node)
        kids = 1.0
        for nxt in {c[len(ctx)] for c, _ in seen if c.startswith(ctx)}:
            kids *= pw(ctx + bytes([nxt]), node)
        return 0.5 * pe(ctx, node) + 0.5 * kids

    def chance(ctx, node, d=0):  # of a 1
        own = ctx[:d]
        if not any(c.startswith(own) for c, _ in seen):
            return 0.5
        a = counts(own, node)
        kt = (a[1] + 0.5) / (sum(a) + 1)
        if d == depth:
            return kt
        stop = 0.5 * pe(own, node) / pw(own, node)
        return stop * kt + (1 - stop) * chance(ctx, node, d + 1)

    known = {b for _, b in seen}
    got = collections.defaultdict(float)
    for r in ctw.model_scores(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), path, slices, "doc_id").collect():
        got[r["doc_id"]] += r["score"]
    for i, t in enumerate(new):
        raw, want = edge + t.encode() + b"\xff", 0.0
        for k in range(depth, len(raw)):
            ctx, bits = (raw[k - depth : k][::-1] if raw[k] in known else None), f"{raw[k]:08b}"
            for j in range(8):
                # a byte that training never saw has its chance without context
                root = counts(b"", bits[:j])
                one = chance(ctx, bits[:j]) if ctx is not None else None
                if one is None:
                    stop = 0.5 * pe(b"", bits[:j]) / pw(b"", bits[:j])
                    one = stop * (root[1] + 0.5) / (sum(root) + 1) + (1 - stop) / 2
                want += np.log10(one if bits[j] == "1" else 1 - one)
        assert abs(got[i] - want) < 2e-3 * abs(want) + 1e-3


def test_language_model_odd(spark, odd):
    out = ctw.scored(odd.select("doc_id", "text")).collect()
    assert len(out) == odd.count() and all(r["score"] < 0 for r in out) and [r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert ctw.scored(odd.select("doc_id", "text").limit(0)).isEmpty()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.cut(stage(spark, frames[-1], SF), f"test-{name}"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    counts = [f.count() for f in frames[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    classes = brute_classes([(r["doc_id"], r["text"]) for r in frames[1].select("doc_id", "text").collect()])
    assert {r["doc_id"] for r in frames[2].select("doc_id").collect()} == set(classes.values())
    assert frames[5].select("doc_id").distinct().count() == counts[-1]


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert collections.Counter(tuple(r) for r in got.select(*want.columns).collect()) == collections.Counter(want.fetchall())
