"""The field: sums and best paths against all labelings, slopes against differences, and rows that it hasn't seen."""

import itertools
import math

import numpy as np
import pytest

from pathloom.llm import pii_crf

# Rows held out of the labelled table, in its form.
HELD_OUT = """
Signed, [N John Smith]
Signed by [N Margaret Atwell] in Dublin.
My name is [N Rosa Blum].
my name is [N Ian McGregor] and I am new here
I am [N Walter Nash], your neighbour.
Dear Ms. [N Vaughan], we are sorry.
Dear [N Philip], come soon.
Mr. [N Oscar Lindqvist] was seen again.
Mr. and Mrs. [N Carver] have gone.
Name: [N Jane Doe]
Author: [N Erik Holm], Oslo
Then [N Barbara Young] opened the door.
We met [N Nathan Cole Burke] at noon.
The song was written by [N Ruth Ellison] last year.
It was [N Martin Dale] who called.
Kind regards, [N Stella Rowe]
Herr [N Uwe Zimmer] ist krank.
Frau [N Petra Lang] hat angerufen.
Mein Name ist [N Rolf Steiner] und ich bin neu.
Ich heiße [N Birgit Kuhn].
Je m'appelle [N Alain Mercier].
Madame [N Odile Roux] est là.
Hier nous avons vu [N Jean Picard] en ville.
Me llamo [N Pablo Ortega] y vivo aquí.
Señor [N Andrés Molina] está fuera.
Sra. [N Pilar Soto] llama mañana.
my ssn is [D 321-54-9876] thanks
SSN [D 433-54-3937] again
the form says [D 509-21-4417] there.
Passport number [D K39T00X12] is old.
My passport is [D G7H8J9102].
IBAN: [D NL91 ABNA 0417 1643 00]
IBAN [D CH93 0076 2011 6238 5295 7] is mine.
send it to [D IT60 X054 2811 1010 0000 0123 456] now
Tax id [D 987-65-4320] is wrong.
The garden behind the church was full of flowers.
Nothing was heard from London until Tuesday.
He bought 12 apples and 3 pears for 7 dollars.
They sailed from New York to the Bank of England.
The name of the street is on the map.
Order 8831-07 came in May 2011.
Der Zug nach Berlin fährt um acht Uhr.
Das Kind spielt mit dem Ball im Garten.
La ville est belle en été.
El perro duerme en la cocina.
Is this the right way? No, it is not.
She was called to the office and left.
The number is not known, nor is the place.
""".strip()


def spans(labels):
    out, begin = set(), None
    for i, y in enumerate([*labels, 0]):
        if begin is not None and (y == 0 or y % 2 == 1 or y != labels[begin] + 1):
            out.add((begin, i, labels[begin]))
            begin = None
        if y % 2 == 1:
            begin = i
    return out


@pytest.fixture(scope="module")
def field():
    return pii_crf.trained(pii_crf.LABELLED)


def decoded(field, words):
    memory = pii_crf.Classes(field)
    classes = np.array([memory[w.encode()] >> 1 for w in words])
    return field.decode(classes, np.zeros(len(words), int), memory.table()).tolist()


def test_the_table_is_learnt(field):
    assert all(decoded(field, words) == list(labels) for words, labels in pii_crf.labelled())


def test_rows_held_out(field):
    found = right = wanted = 0
    for words, labels in pii_crf.labelled(HELD_OUT):
        got, want = spans(decoded(field, words)), spans(labels)
        found, right, wanted = found + len(got), right + len(got & want), wanted + len(want)
    assert wanted == 35
    # as the README states
    assert right / found >= 0.85 and right / wanted >= 0.75, (right, found, wanted)


def small():
    rows = list(pii_crf.labelled())[:6] + list(pii_crf.labelled())[55:58]
    return pii_crf.Field([(w[:4], y[:4]) for w, y in rows], steps=15)


def score(field, memory, words, labels):
    table, n = memory.table(), len(words)
    classes = [memory[w.encode()] >> 1 for w in words]
    at = {0: 0, -1: -1, -2: -2, 1: 1, 2: 2}
    total = float(field.start[labels[0]] + field.banned_start[labels[0]])
    for i, y in enumerate(labels):
        total += sum(float(table[j][classes[i + d] if 0 <= i + d < n else 0][y]) for j, d in enumerate(at))
    return total + sum(float(field.pair[a, b] + field.banned[a, b]) for a, b in itertools.pairwise(labels))


def test_best_path_and_sums_against_all_labelings():
    field = small()
    memory = pii_crf.Classes(field)
    for words in (["my", "name", "is", "Tom."], ["Anna", "Keller"], ["SSN:", "078-05-1120", "x"], ["Zq"]):
        for w in words:
            memory[w.encode()]
        every = {y: score(field, memory, words, y) for y in itertools.product(range(len(pii_crf.LABELS)), repeat=len(words))}
        best = max(every.values())
        assert math.isclose(every[tuple(decoded(field, words))], best, abs_tol=1e-3)
        total = best + math.log(sum(math.exp(s - best) for s in every.values()))
        gold = decoded(field, words)
        got = field.slopes(field.batch([(words, gold)]))[0]
        assert abs(got - (every[tuple(gold)] - total)) < 1e-3


def test_slopes_are_differences():
    field = small()
    batch = field.batch([(w[:4], y[:4]) for w, y in list(pii_crf.labelled())[:5]])
    _, slopes = field.slopes(batch)
    rng = np.random.default_rng(3)
    for t, g in zip([*field.unary, field.pair, field.start], slopes, strict=True):
        flat, own = t.reshape(-1), g.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            was = flat[i]
            flat[i] = was + 1e-4
            up = field.slopes(batch)[0]
            flat[i] = was - 1e-4
            down = field.slopes(batch)[0]
            flat[i] = was
            assert abs((up - down) / 2e-4 - own[i]) < 1e-4


def test_spans_in_texts(spark):
    texts = ['He said: "I met Barbara Young." Then (Mr. Oscar Lindqvist, it was) left.\nSSN: 321-54-9876, mail a.b@c.example', None, "", "Ⅷ ẞ 😀 \x00  "]
    rows = pii_crf.personal_data(spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")).collect()
    for r in rows:
        if r.doc_id:
            assert r.found == []
            continue
        got = [(s.kind, texts[0][s.start : s.end], s.base) for s in r.found]
        assert got == [("email", "a.b@c.example", True), ("name", "Barbara Young", False), ("name", "Oscar Lindqvist", False), ("id", "321-54-9876", False)]
