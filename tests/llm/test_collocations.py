"""Phrase mining against full counts."""

import collections
import re

import pytest

from cardlake.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least, share):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in (1, 2, 3):
                f.update((lang or "und", *ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = []
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = collections.Counter()
    for p, a in candidates.items():
        if len(p) == 4:
            for part in (p[:3], (p[0], *p[2:])):
                longer[part] = max(longer[part], a)
    for p, a in candidates.items():
        if len(p) == 4 or 100 * longer[p] < share * a:
            score, k = min((1000000 * a * a // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p)))
            found.append((p[0], -score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(p[0], *p[k:])]))
    out, rank = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize(("top", "least", "first"), [(30, 3, None), (200, 2, 1), (7, 5, 3)])
def test_against_full_counts(spark, top, least, first):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang", "doc_id")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    got = collocations.mine(docs, top=top, least=least, first_floor=first).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, top, least, 50)


def test_odd_tables(spark):
    rows = [(None, "en"), ("", "en"), ("a b c. a b c\nA B\tC ,x", None), ("a b c", "und"), ("é É é É", "fr"), ("w " * 30_000, "en"), ("\x00 b \x00 b", "zz")] * 2
    docs = spark.createDataFrame([(t, g, 1, "p", "w") for t, g in rows], "text string, lang string, a int, phrase string, w1 string")
    got = collocations.mine(docs, top=50, least=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 50, 2, 50)
    assert {r["lang"] for r in got} == {"en", "und", "fr", "zz"}
    assert collocations.mine(docs.limit(0)).isEmpty()
    assert collocations.mine(docs.filter("lang = 'fr'"), least=100).isEmpty()
