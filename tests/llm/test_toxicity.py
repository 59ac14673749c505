import random
import re
import time

import numpy as np
import pytest

from newsquery.llm import toxicity as tx
from newsquery.llm.common import is_held_out


def distance(a, b):
    """Edits with swaps of neighbours, each character edited once."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    for _ in range(12):
        terms = sorted({word(rng.randint(3, 8)) + rng.choice(["", "", "*"]) for _ in range(6)})
        allowed = [rng.randint(0, 2) for _ in terms]
        automaton = tx.LexiconAutomaton(terms, allowed)
        for _ in range(300):
            token = word(rng.randint(1, 9)) if rng.random() < 0.5 else rng.choice(terms).rstrip("*") + word(rng.randint(0, 2))
            best = None
            for t, k in zip(terms, allowed):
                ends = [token[:i] for i in range(len(token) + 1)] if t.endswith("*") else [token]
                e = min(distance(t.rstrip("*"), x) for x in ends)
                if e <= k and (best is None or e < best):
                    best = e
            found = automaton.match(token)
            assert (found[1] if found else None) == best, (terms, allowed, token, found, best)


def test_context_separates_quotation_from_abuse():
    scanner = tx.Scanner(["idiot"], [1])
    weight = lambda text: scanner.scan(text)[0][4]
    assert weight("you idiot, go away") == weight("an idiot came by") == 1
    assert weight('he said "what an idiot" and left') < weight('the word "idiot" is old') + 0.2 < 0.7
    assert weight('you "idiot" you, idiot!') > weight('they wrote "idiot" there')
    assert scanner.scan(None) == [] == scanner.scan("") == scanner.scan("nothing here")


TOXIC = "loser moron pathetic worthless disgusting".split()
STEMS = ["lowei", "vequa"]


@pytest.fixture(scope="module")
def model_and_rows(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}{c}" for a in "br gl st tr pl".split() for b in "a e o u".split() for c in "nd rm sk lt ve".split()]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = i % 8 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC) if i % 16 == 0 else rng.choice(STEMS) + rng.choice(plain))
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None, 0.5), (5001, "", 0.5), (None, "you loser", 0.5), (7, rows[7][1], 0.5)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    return tx.fit(docs, marks), docs, dict(labels)


def test_lexicon_is_learned(model_and_rows):
    model, _, _ = model_and_rows
    assert set(TOXIC) <= {t.rstrip("*") for t in model.terms}
    assert any(t.startswith("lowe") for t in model.terms) and any(t.startswith("vequ") for t in model.terms)
    assert len(model.terms) < 20


def test_held_out_accuracy(model_and_rows):
    model, docs, labels = model_and_rows
    got = tx.score(docs, model).collect()
    assert len(got) == 1504
    mine = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in labels and is_held_out(r["doc_id"])]
    assert np.mean([p == y for _, y, p in mine]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = {r["doc_id"]: r["score"] for r in got}
    assert empty[5000] == empty[5001] < 0.5 < empty[None]


def test_misspellings_and_long_texts(spark, model_and_rows):
    model, _, _ = model_and_rows
    texts = ["stand you patethic brand worthles stand", "plan " * 40000 + " worthless moron disgusting loser", "brand stand glorm", "x" * 100000, "disgustng l0ser stand brand you"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in tx.score(docs, model, spans=True).collect()}
    assert got[0]["predicted"] == 1 and {h["edits"] for h in got[0]["hits"]} == {1, 2}
    assert len(got[1]["hits"]) == 4 and got[2]["predicted"] == got[3]["predicted"] == 0
    assert got[4]["predicted"] == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(docs, marks)
    assert model.terms == [] and tx.score(docs, model).first()["predicted"] == 0
    assert tx.score(docs.limit(0), model).collect() == []
    assert tx.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).terms == []


def test_contexts_against_a_plain_reading():
    """Quotation marks counted from each line's begin for every hit."""
    rng = random.Random(9)
    scanner = tx.Scanner(["loser", "moron*"], [1, 0])
    for _ in range(300):
        text = "".join(rng.choice(["loser", "moronic", "loosr", " ", " ", " ", '"', "“", "»", "\n", "you", "said", "!", "plain"]) for _ in range(rng.randint(0, 60)))
        low = text.lower()
        tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)]
        hits = [scanner.automaton.match(t) for t, *_ in tokens]
        want = []
        for i, (t, a, b) in enumerate(tokens):
            if not hits[i]:
                continue
            line = low[low.rfind("\n", 0, a) + 1 :].split("\n")[0]
            at = a - (low.rfind("\n", 0, a) + 1)
            quoted = sum(c in "\"“”«»„‟" for c in line[:at]) % 2 == 1 and any(c in "\"“”«»„‟" for c in line[at + b - a :])
            near = [j for j in range(max(0, i - 6), min(len(tokens), i + 7)) if j != i]
            quotation = 0.6 * quoted + 0.4 * any(tokens[j][0] in tx.REPORTING for j in near)
            span = low[tokens[near[0]][1] if near else a : (tokens[near[-1]][2] if near else b) + 2]
            abuse = 0.4 * any(tokens[j][0] in tx.ADDRESSING for j in near) + 0.4 * any(hits[j] is not None for j in near) + 0.2 * ("!" in span)
            want.append((*hits[i], a, b, 1 - 0.8 * max(0.0, quotation - 0.5 * abuse)))
        assert scanner.scan(text) == want


def test_time_is_linear_in_the_hits_of_a_line():
    scanner = tx.Scanner(["loser"], [1])
    seconds = []
    for n in (4000, 32000):
        text = '"loser" and ' * n
        scanner.scan(text)
        start = time.perf_counter()
        assert len(scanner.scan(text)) == n
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 30 * seconds[0]
