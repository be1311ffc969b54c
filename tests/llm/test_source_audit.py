import re
from collections import Counter, defaultdict

import pytest

from pairforge.llm import source_audit

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, min_docs=3, ranks=200):
    docs, out = defaultdict(list), []
    for lang, source, text in rows:
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        docs[lang or ""].append((source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", folded)))
    for lang, found in docs.items():
        seen = Counter(t for _, words in found for t in set(words))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        counts = {s: Counter() for s, _ in found}
        for s, words in found:
            counts[s].update(w for w in words if seen[w] >= min_docs)
        total = Counter()
        for c in counts.values():
            total.update(c)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        gap = lambda p, q: (p - q) ** 2 // q
        p = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        q = {t: share(total, t) for t in kept}
        for s in counts:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:ranks]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("held,min_docs,ranks", [(300_000, 3, 200), (50, 2, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, held, min_docs, ranks):
    monkeypatch.setattr(source_audit, "HELD_TERMS", held)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    got = source_audit.audit(df.repartition(5), min_docs=min_docs, ranks=ranks)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, min_docs, ranks)


def test_odd_documents_and_none(spark, odd_docs, no_docs):
    more = [(20 + i, t, "zz", s, 0) for i, (t, s) in enumerate([("Ünï Ünï É é B_C b c", "a"), ("Ünï b", "b"), ("Ünï b", None), ("b c c", "b"), (None, "empty"), ("!!", "marks"), ("😀b 😀 \x7f c", "a")])]
    df = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    for name in ("term", "count", "docs", "column", "terms", "value", "item", "rank", "n", "total"):
        df = df.withColumn(name, df.n_chars)
    assert sorted(map(tuple, source_audit.audit(df).collect())) == brute(rows)
    assert source_audit.audit(no_docs).count() == 0
    rare = spark.createDataFrame([("x", "a", "one"), ("x", "b", "two"), ("y", "a", None)], "lang string, source string, text string")
    assert sorted(map(tuple, source_audit.audit(rare).collect())) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]


def test_texts_are_split_at_separators_only(monkeypatch):
    text = "abc def;ghi漢字jkl " + "x" * 50 + " Tail"
    whole = [w for part in source_audit.terms_of(text.encode()) for w in part]
    for size in (1, 3, 7, 30):
        monkeypatch.setattr(source_audit, "SPLIT_BYTES", size)
        assert [w for part in source_audit.terms_of(text.encode()) for w in part] == whole
    assert [w.decode() for w in whole] == ["abc", "def", "ghi漢字jkl", "x" * 50, "tail"]
