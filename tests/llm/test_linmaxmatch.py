import random

from codeatlas.llm import linmaxmatch as m
from codeatlas.llm.queries import vocabulary_file
from codeatlas.llm.words import SPACE

PATH = vocabulary_file("byte_bpe_multi_50k.tiktoken")


def greedy(word, first, later, longest=None):
    n, at = 0, 0
    while at < len(word):
        pieces = first if not at else later
        end = next((e for e in range(min(len(word), at + longest) if longest else len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_automaton_against_greedy():
    r = random.Random(6)
    for _ in range(60):
        first = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 9))}
        later = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 9))}
        auto = m.Automaton(sorted(first), sorted(later))
        for _ in range(120):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            assert auto.count(word) == greedy(word, first, later)


def test_odd_documents(odd, odd_documents):
    first, later = (set(x) for x in m.vocabulary(PATH))
    want, longest = [], max(map(len, first | later))
    for doc, text, *_ in odd_documents:
        data = bytes(32 if SPACE[b] else b for b in (text or "").encode())
        known = {w: greedy(w, first, later, longest) for w in set(data.split(b" ")) if w}
        want.append((doc, text, [known[w] for w in data.split(b" ") if w]))
    got = {}
    for r in m.token_counts(odd, PATH).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_tokens"], r["n_unknown"]))
    assert sum(map(len, got.values())) == len(odd_documents)
    for doc, _, n in want:
        assert (len(n), sum(max(c, 1) for c in n), sum(c == 0 for c in n)) in got[doc]


def test_empty_table(none):
    assert m.token_counts(none, PATH).count() == 0
