import itertools
import random
import re

import numpy as np

from codeatlas.llm import robust_rules as rr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def transformed(text):
    s, lines = counts(text), sum(1 for x in (text or "").split("\n") if WORD.search(x))
    n = max(s[0], 1)
    return [round(np.log1p(s[0]), 6), round(min(s[1] / n, 60.0), 6), round(np.sqrt(min(s[2] / n, 4.0)), 6), round(np.sqrt(min(s[3] / max(lines, 1), 4.0)), 6), round(np.sqrt(min(s[4] / n, 4.0)), 6)]


def fails(s):
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


def scatter(core):
    mu = core.mean(0)
    return mu, (core - mu).T @ (core - mu) / len(core)


def wide(cov):
    return cov * rr.CORE / rr._chi2_cdf(rr.chi2_cut(rr.CORE, rr.D), rr.D + 2) + np.diag(np.square(rr.FLOOR))


def mcd(x, tries=300):
    """The core of least determinant over many random starts, all concentrated until nothing changes, in memory."""
    r, best = np.random.RandomState(0), None
    for _ in range(tries):
        mu, cov = scatter(x[r.choice(len(x), min(len(x), rr.D + 1), replace=False)])
        last = np.inf
        while True:
            far = np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(wide(cov)), x - mu)
            bins = np.floor(np.log2(far + 1e-9) * rr.BINS)
            mu2, cov2 = scatter(x[bins <= np.sort(bins)[int(np.ceil(rr.CORE * len(x) - 1e-9)) - 1]])
            det = np.linalg.slogdet(wide(cov2))[1]
            if not det < last - 1e-9:
                break
            mu, cov, last = mu2, cov2, det
        if best is None or last < best[0] - 1e-9:
            best = last, mu, cov
    return best


def brute(rows):
    return sorted(((r[0], *(s := counts(r[1])), fails(s), v) for r, v in zip(rows, verdicts(rows), strict=True)), key=repr)


def verdicts(rows, cut=rr.CUT):
    """kept of each row (doc_id, text, lang, source, ...), by mcd() and the same shrinkage with numpy."""
    stats, x = [counts(r[1]) for r in rows], np.array([transformed(r[1]) for r in rows])
    fine = [i for i, s in enumerate(stats) if not fails(s)]
    chain = lambda r: [("all",), ("lang", r[2]), ("pair", r[2], r[3])]
    members = {}
    for i in fine:
        for g in chain(rows[i]):
            members.setdefault(g, []).append(i)
    own = {g: (len(m), *mcd(x[m])[1:]) for g, m in members.items()}
    out = []
    for i, r in enumerate(rows):
        kept = not fails(stats[i])
        if kept:
            top, low, pair = (own[g] for g in chain(r))
            mu, cov = top[1:]
            for n, m, c in (low, pair):
                k = n / (n + rr.LEAST)
                mu, cov = k * m + (1 - k) * mu, k * c + (1 - k) * cov
            kept = (x[i] - mu) @ np.linalg.inv(wide(cov)) @ (x[i] - mu) <= rr.chi2_cut(cut, rr.D)
        out.append(bool(kept))
    return out


def got(df, **named):
    found = rr.robust_rules(df, **named).select("doc_id", *rr.COUNTS, "base_failed", "kept").collect()
    return sorted((tuple(r) for r in found), key=repr)


def test_odd_documents(odd, odd_documents):
    """Base columns and base failures of odd rows; keep_regular() keeps the rows, whole, that robust_rules() keeps."""
    found = got(odd)
    assert [x[:-1] for x in found] == sorted([(d[0], *counts(d[1]), fails(counts(d[1]))) for d in odd_documents], key=repr) and not any(x[-1] and x[-2] for x in found)
    rows = rr.keep_regular(odd)
    assert rows.columns == odd.columns and all(not fails(counts(r["text"])) for r in rows.collect())
    assert sorted((r["doc_id"] for r in rows.collect()), key=repr) == sorted((x[0] for x in found if x[-1]), key=repr)


def test_outliers_are_found(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(800)]
    rows = []
    for k in range(600):
        text = " ".join(r.choice(words) for _ in range(r.randint(60, 300)))
        rows.append((k, text, "en" if k % 3 else "de", "web" if k % 2 else "book", 1))
    for k in range(600, 612):  # walls of symbols
        rows.append((k, " ".join("#$%|" * r.randint(1, 3) for _ in range(150)) + " ".join(words), "en", "web", 1))
    for k in range(612, 615):  # the same few lines over and over, with few repeated words in a row
        rows.append((k, "\n".join([" ".join(words[i : i + 2]) for i in range(40)] * 3 + [" ".join(r.sample(words, 200)) for _ in range(3)]), "en", "web", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = got(df)
    assert found == brute(rows)
    assert not any(x[-1] for x in found if x[0] >= 600) and all(x[-1] for x in found if x[0] < 600)


def test_least_determinant(spark):
    """Cores of small groups against all subsets of their size."""
    r = np.random.RandomState(4)
    groups = {f"g{k}": np.round(np.concatenate([r.randn(9 + k, rr.D) * [1, 1, 0.3, 0.3, 0.3], r.randn(3, rr.D) + [9, 9, 3, 3, 3]]), 6) for k in range(3)}
    points = spark.createDataFrame([(g, x.tolist()) for g, own in groups.items() for x in own], "g string, x array<double>").repartition(3)
    found = {e["g"]: e for e in rr.estimate(points).collect()}
    for g, x in groups.items():
        size = int(np.ceil(rr.CORE * len(x)))
        least = min(np.linalg.slogdet(wide(scatter(x[list(c)])[1]))[1] for c in itertools.combinations(range(len(x)), size))
        det = np.linalg.slogdet(wide(rr.full(np.array([found[g]["cov"]]))[0]))[1]
        assert found[g]["n"] == len(x) and abs(det - least) < 1e-6


def test_empty_table(none):
    assert got(none) == []


def test_small_languages_are_judged(spark):
    """Rows of a language with few rows, or one, are judged mostly by the estimate of all rows."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(800)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(60, 300))), ["xx", None][k % 2] if k < 20 else "en", "web", 1) for k in range(400)]
    wall = " ".join("#$%|" * r.randint(1, 3) for _ in range(150)) + " ".join(words)
    rows += [(400, wall, "xx", "web", 1), (401, wall, None, "book", 1), (402, wall, "yy", None, 1)]
    found = rr.robust_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted(x["doc_id"] for x in found if not x["kept"]) == [400, 401, 402]
    assert all(x["distance"] is not None for x in found if not x["base_failed"])
