import re
from collections import Counter, defaultdict

from corpus import documents, frame

from postlake.llm import quality as Q


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


def brute(docs):
    hist = [defaultdict(Counter) for _ in range(3)]
    rows = []
    for d in docs:
        n, chars, sym, dup, rep, lines = base(d[1])
        v = {"symbols": min(1000, sym * 1000 // max(1, chars)), "lines": min(1000, dup * 1000 // max(1, lines)), "length": min(10_000, chars * 100 // max(1, n))}
        rows.append((d, n, chars, sym, dup, rep, v))
        if n >= 50:
            for m, x in v.items():
                for h, key in zip(hist, ((d[2], d[3]), (d[2],), ())):
                    h[key, m][x] += 1

    def quartiles(c):
        xs = sorted(c.elements())
        return xs[-(-len(xs) // 4) - 1], xs[-(-3 * len(xs) // 4) - 1]

    out = []
    for d, n, chars, sym, dup, rep, v in rows:
        failed = n < 50 or 100 * rep > 50 * n
        kept = not failed
        for m, (_, slack, low) in Q.MEASURES.items():
            c = next((h[key, m] for h, key in zip(hist, ((d[2], d[3]), (d[2],))) if sum(h[key, m].values()) >= Q.LEAST_DOCS), hist[2][(), m])
            if kept and c:
                a, b = quartiles(c)
                kept = v[m] <= b + 3 * (b - a) + slack and not (low and v[m] < a - 3 * (b - a) - slack)
        out.append((d[0], n, chars, sym, dup, rep, failed, kept))
    return Counter(out)


def test_like_brute_force(spark):
    docs = documents(120)
    got = Counter(tuple(r) for r in Q.quality(frame(spark, docs)).collect())
    assert got == brute(docs)
    assert any(not k[6] and not k[7] for k in got) and any(k[7] for k in got)


def test_rows_and_fences_by_shuffle(spark, monkeypatch):
    docs = documents(120)
    monkeypatch.setattr(Q, "MAX_SENT", 0)
    good = Q.good_documents(frame(spark, docs))
    assert good.columns == frame(spark, docs).columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(k[0] for k, n in brute(docs).items() if k[7] for _ in range(n))


def test_empty(spark):
    assert Q.quality(frame(spark).limit(0)).count() == 0
