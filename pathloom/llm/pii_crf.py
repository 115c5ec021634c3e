"""Operator 6: personal data by a linear-chain conditional random field over word shapes, with fixed patterns beside it."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_texts

#: Kinds that the field finds; each has a label for its first word and one for the others.
KINDS = ("name", "id")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
#: Words that a name has at most.
NAME_WORDS = 6
#: Words that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 500_000

# The labelled table. Words in [N ...] are a name, in [D ...] an identity number; all others are neither.
LABELLED = """
My name is [N Anna Keller] and I live here.
my name is [N Tom].
Hello, my name is [N Peter van Dyke], nice to meet you.
I am [N Mary-Jane O'Neil], the new teacher.
I'm [N Robert Hale] from the office.
This is [N Julia Stone] speaking.
He is called [N Frank Miller] by all.
A man named [N George Walsh] asked for you.
Dear Mr. [N Jonas Brandt], thank you for the letter.
Dear Mrs. [N Okafor], we have sent it.
Dear [N Susan], how are you?
Please ask Dr. [N Maria Lopez] about the results.
Signed by Mr. [N Hugh Oliver Stone] on Monday.
Signed, [N Martha Quinn]
Sincerely, [N Edward Norton]
Kind regards, [N Helen Moss]
Yours, [N William Ford]
Ms. [N Chen] will call back later.
Mr. and Mrs. [N Harris] moved away.
Mr. And Mrs. [N Doyle] Were Late.
contact: Mr. [N Paul Weber]
Name: [N Jane Fisher]
name: [N Oliver Grant]
Author: [N Simon Blake], London
Patient: [N Laura Hill], seen on Monday
Yesterday we met [N Daniel Craig Moore] in the park.
The book was written by [N Thomas Wright] in 1998.
Then [N Emma Clarke] told us that it was too late.
They gave the prize to [N Henry Adams] and left.
[N Alice Morgan] said that she would come.
[N Peter Lang] and [N Nora Beck] were there.
It was [N Samuel Reed] who found it.
with [N Victor Hugo Palmer], who was ill
by [N J. R. Smith] and others
Herr [N Karl Baumann] wohnt in der Stadt.
Frau [N Ilse Vogt] kommt morgen nicht.
Mein Name ist [N Lukas Hartmann] und ich komme aus Bonn.
Ich bin [N Greta Schulz], die neue Lehrerin.
Ich heiße [N Ludwig von Berg].
Mit freundlichen Grüßen, [N Dieter Kraus]
Gestern hat [N Heinz Lehmann] angerufen.
Je m'appelle [N Claire Dubois] et je travaille ici.
Je suis [N Marc Lefebvre], votre voisin.
Monsieur [N Henri Laurent] est parti hier.
Madame [N Sophie Martin] a dit non.
Mme [N Petit] est malade.
Hier nous avons vu [N Luc Moreau] au parc.
Me llamo [N Carlos Ruiz] y soy de Lima.
Soy [N Lucía Romero], su vecina.
Señor [N Miguel Torres] no puede venir.
Señora [N Elena Vega] llega hoy.
Sra. [N Marta Gil] vive lejos.
Ayer vimos a [N José de la Cruz] en el parque.
Her SSN is [D 219-09-9999] as stated.
SSN: [D 078-05-1120]
ssn [D 457-55-5462] was used before.
my ssn is [D 219099999] and that is all
the number [D 536-22-8145] is his
he wrote [D 601-33-9207] on the form.
Social security number [D 402 11 8890] was lost.
Passport number [D C01X00T47] expired.
passport no. [D L8988901C] issued in 2010.
My passport is [D X4R7K2219].
Reisepass Nr. [D C4VK81T20] ist verloren.
Driver's license [D B6254-77019] was shown.
IBAN [D DE89 3704 0044 0532 0130 00] is the account.
IBAN: [D GB82 WEST 1234 5698 7654 32]
iban [D FR1420041010050500013M02606] please.
Please pay to [D ES91 2100 0418 4502 0005 1332] by Friday.
Konto [D AT61 1904 3002 3457 3201] bei der Bank
The tax id [D 912-77-4821] must be given.
Tax number [D 93815/08152] is on the bill.
Steuernummer [D 181/815/08155] steht oben.
The house is old and the garden is large.
It was the best of times, and the worst.
On Monday the Council of Europe met in Paris.
The name is not known to us.
My name is on the list of the school.
The passport is in the drawer.
In 2019 the price was 1200 dollars.
Order 4711-22 was sent to New York in May.
We flew from New York to Los Angeles in June.
The United States and the United Kingdom signed it.
He works at the Bank of England in London.
She reads the New York Times every Sunday.
He paid 12-13 times as much in 1998-99.
Call 555-1234 or visit us.
Der Name ist nicht bekannt.
Die alte Stadt liegt am Fluss.
Der Mann ging mit dem Hund in den Wald.
Die Deutsche Bank hat heute geschlossen.
Am Montag war das Haus am See leer.
Le nom est inconnu dans cette ville.
La Tour Eiffel est à Paris.
La casa de la calle es grande.
El Banco de España está cerrado.
The work is under the GNU General Public License, version 3.
Copyright by the authors, all Rights Reserved under the Apache License.
The Doctor said that nothing was wrong.
The Rhine and the Danube are rivers of Europe.
In May the Queen went to Scotland with the Court.
It was said - Heaven knows why - that Winter would be long.
Der Garten hinter dem Haus, Blumen und Bäume, alles war grün.
Im Sommer fahren viele Leute an die See.
Au mois de Mai la Seine monte.
En Mayo el Rey fue a Sevilla.
No number was given in Chapter 12 of the Book.
She said that Monsieur was a word from French.
And The End Of It All Was Near.
Thank you for the letter dated 12.03.2001.
SSN numbers are private.
IBAN codes have 22 characters in Germany.
This is Paris and that is Rome.
Today is Monday. It is late.
I am here and I am glad.
I am Not Sure About That.
This is The Best Thing Ever.
He was sincerely glad, and so was she.
Dear friends, thank you all.
Dear Sir or Madam, the order is late.
Yours was the first, mine the last.
I am [N David Cole] from the bank.
I am [N Irene Walsh]
[N Fred Olsen] lives in the next street.
[N Linda Gray] was the first to see it.
The photo is under CC BY 2.0 by its makers.
All rights are with the makers.
from 10.0.0.1 to 10.2.3.44 at 4111 1111 1111 1111
a@b.example, +1 (555) 010-9999, 10.0.0.1, 4000 1234 5678 9010
the code 4716320949013 was new, 77.13.2.9 too.
item 12345678901 and part 88-1204 on page 3
Meet us at five or at six at the station.
He was at home at ten and at work at two.
""".strip()

# Words that announce a name or a number, by what they are.
CUES = {
    "title": "mr mr. mrs mrs. ms ms. dr dr. prof prof. herr frau monsieur madame mme m. señor señora sr. sra. sr sra".split(),
    "name": "name named called author patient signed sincerely regards yours dear heiße m'appelle llamo grüßen".split(),
    "is": "is ist am i'm bin suis soy :".split(),
    "number": "ssn passport iban tax reisepass license steuernummer konto account social".split(),
    "no": "number no. no id nummer nr nr. numéro número".split(),
    "small": "van von de der del di la".split(),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}
EDGES = "\"'()[]{},;:!?“”‘’«»¿¡"
RUN = re.compile(r"([xXd])\1*")
END = re.compile(r"[.!?]+[\"')\]]*$")
LETTERS = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "x"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X")})


def feature(word: str) -> tuple[str, str, str, str]:
    """(cue, shape, kind, what follows it) of a word, each of them whole. The shape has the lengths of runs of digits and capitals; letters beyond ASCII
    count by their case. The kind is a coarse class that unseen shapes share."""
    cue = CUE_OF.get(word.lower()) or CUE_OF.get(word.lower().rstrip(",;:!?")) or ""
    core = word.strip(EDGES) or word
    cue = cue or CUE_OF.get(core.lower()) or CUE_OF.get(core.lower().rstrip(".")) or ""
    tail = ":" if word[-1] in ":," else "." if word[-1] in ".!?" else ""
    core = core.rstrip(".") or core
    if not core.isascii():
        core = "".join(c if c.isascii() else "X" if c.isupper() else "x" if c.isalpha() else "~" for c in core)
    signs = core.translate(LETTERS)
    if not signs.strip("x"):
        return cue, "x", "lower", tail
    shape = RUN.sub(lambda m: m[1] if m[1] == "x" else f"{m[1]}{min(len(m[0]), 20)}", signs)
    if "d" in signs:
        digits = signs.count("d")
        kind = "address" if "@" in signs else ("alnum" if "x" in signs or "X" in signs else "number" if digits == len(signs) else "signed") + str(min(digits, 6) if digits < 9 else 9)
    elif signs.strip("xX-'.") == "" and signs.strip("-'."):
        kind = "cap" if re.fullmatch(r"X1?x(?:[-']?X1?x)*|X1'X1x|X1x", shape) else "initial" if signs == "X" else "upper" if "x" not in signs else "mixed"
    else:
        kind = "other"
    return cue, shape, kind, tail


def ends_chain(word: str, found: tuple[str, ...]) -> bool:
    """A sentence ends after a stop, but not after a title or an initial."""
    return found[0] != "title" and found[2] != "initial" and END.search(word) is not None


def labelled(table: str = LABELLED) -> Iterator[tuple[list[str], list[int]]]:
    """(words, labels) of each line of a labelled table."""
    kinds = {"N": 1, "D": 3}
    for line in table.splitlines():
        words, labels, kind, first = [], [], 0, False
        for w in line.split():
            if w[0] == "[" and w[1:] in kinds:
                kind, first = kinds[w[1:]], True
                continue
            closing = kind and re.search(r"\]([.,;:!?]*)$", w) and not CUE_OF.get(w)
            words.append(re.sub(r"\]([.,;:!?]*)$", r"\1", w) if closing else w)
            labels.append(0 if not kind else kind if first else kind + 1)
            first = False
            if closing:
                kind = 0
        yield words, labels


class Field:
    """Weights for what a word is, and what the words around it are, under each label; and for each pair of labels in a row. A word is known by its
    features and, where the table has it twice or more, by itself."""

    OFFSETS = (0, -1, -2, 1, 2)
    STREAMS = 5

    def __init__(self, rows: list[tuple[list[str], list[int]]], steps: int = 250, rate: float = 0.1, decay: float = 3e-3):
        k = len(LABELS)
        seen = Counter(w.strip(EDGES + ".").lower() for words, _ in rows for w in words)
        self.words = {w for w, n in seen.items() if n > 1}
        values = [self.streams(w) for words, _ in rows for w in words]
        # value 0 of a stream is any other value and whatever lies beyond a chain
        self.values = [{v: i + 1 for i, v in enumerate(sorted({x[s] for x in values}))} for s in range(self.STREAMS)]
        self.unary = [np.zeros((len(self.OFFSETS), len(v) + 1, k)) for v in self.values]
        self.pair, self.start = np.zeros((k, k)), np.zeros(k)
        # an inside label follows its beginning or itself only
        self.banned, self.banned_start = np.zeros((k, k)), np.zeros(k)
        for y in range(2, k, 2):
            self.banned[:, y] = self.banned_start[y] = -1e4
            self.banned[y - 1, y] = self.banned[y, y] = 0.0
        self.train(rows, steps, rate, decay)

    def streams(self, word: str) -> tuple[str, ...]:
        own = word.strip(EDGES + ".").lower()
        return (*feature(word), own if own in self.words else "")

    def known(self, own: tuple[str, ...]) -> tuple[int, ...]:
        return tuple(v.get(x, 0) for v, x in zip(self.values, own, strict=True))

    def shifted(self, classes: np.ndarray, chains: np.ndarray) -> list[np.ndarray]:
        """For each offset the class found there, 0 beyond the chain."""
        out = []
        for d in self.OFFSETS:
            other = np.zeros_like(classes)
            if d == 0:
                other = classes
            elif d < 0 and len(classes) > -d:
                other[-d:] = np.where(chains[-d:] == chains[:d], classes[:d], 0)
            elif d > 0 and len(classes) > d:
                other[:-d] = np.where(chains[:-d] == chains[d:], classes[d:], 0)
            out.append(other)
        return out

    def may_be(self, word: tuple[str, ...]) -> np.ndarray:
        """0 for the labels that a word can have, by what a name and a number are made of, and a large negative number for all others. A name is of
        words with capitals and the small words between them, an identity number of words with digits and groups of up to four capitals."""
        cue, shape, kind = word[:3]
        small, letters = cue == "small", kind in ("cap", "initial", "mixed", "upper")
        digits = kind[:5] in ("alnum", "numbe", "signe")
        group = kind in ("upper", "initial") and shape in ("X1", "X2", "X3", "X4")
        fine = [True, letters and not cue, small or (letters and not cue), digits or group, digits or group]
        return np.where(fine, 0.0, -1e4)

    def slopes(self, batch: tuple) -> tuple[float, list[np.ndarray]]:
        """(log-likelihood, its slopes by unary weights of each stream, pairs and start) of labelled chains, by forward and backward sums over all
        chains at once."""
        found, chains, at, gold, live, bans = batch
        (m, length), k = live.shape, len(LABELS)
        emit = np.zeros((m, length, k))
        emit[chains, at] = bans
        for u, values in zip(self.unary, found, strict=True):
            emit[chains, at] += sum(u[j][c] for j, c in enumerate(values))
        move = self.pair + self.banned
        alpha, beta = np.zeros((m, length, k)), np.zeros((m, length, k))
        alpha[:, 0] = self.start + self.banned_start + emit[:, 0]
        for t in range(1, length):
            x = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + emit[:, t]
            alpha[:, t] = np.where(live[:, t, None], x, alpha[:, t - 1])
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for t in range(length - 2, -1, -1):
            x = np.logaddexp.reduce(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], x, 0.0)
        node = -np.exp(alpha + beta - total[:, None, None])[chains, at]
        node[np.arange(len(gold)), gold] += 1
        edge = np.zeros((k, k))
        for t in range(1, length):
            p = np.exp(alpha[:, t - 1, :, None] + move + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
            edge -= p[live[:, t]].sum(0)
        same = np.flatnonzero(chains[1:] == chains[:-1])
        np.add.at(edge, (gold[same], gold[same + 1]), 1)
        grads = [np.zeros_like(u) for u in self.unary]
        for g, values in zip(grads, found, strict=True):
            for j, c in enumerate(values):
                np.add.at(g[j], c, node)
        right = emit[chains, at][np.arange(len(gold)), gold].sum() + move[gold[same], gold[same + 1]].sum() + (self.start + self.banned_start)[gold[at == 0]].sum()
        return float(right - total.sum()), [*grads, edge, node[at == 0].sum(0)]

    def batch(self, rows: list[tuple[list[str], list[int]]]) -> tuple:
        values = np.array([self.known(self.streams(w)) for words, _ in rows for w in words])
        sizes = [len(w) for w, _ in rows]
        chains, at = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.arange(n) for n in sizes])
        live = np.zeros((len(rows), max(sizes)), dtype=bool)
        live[chains, at] = True
        return [self.shifted(values[:, s], chains) for s in range(self.STREAMS)], chains, at, np.concatenate([y for _, y in rows]), live, np.array([self.may_be(self.streams(w)) for words, _ in rows for w in words])

    def train(self, rows, steps, rate, decay) -> None:
        """Up the likelihood by Adam steps; the table is small and in memory, and no number is random."""
        batch, theta = self.batch(rows), [*self.unary, self.pair, self.start]
        first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for step in range(1, steps + 1):
            for t, g, a, b in zip(theta, self.slopes(batch)[1], first, second, strict=True):
                g = decay * t - g / len(rows)
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                t -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def table(self, classes: list[tuple[int, ...]], bans: list[np.ndarray]) -> np.ndarray:
        """For each offset and class of words, given by the values of its streams, the weights of the labels. The first class is beyond a chain."""
        v = np.array(classes)
        out = sum(u[:, v[:, s]] for s, u in enumerate(self.unary))
        out[0] += np.array(bans)
        return out.astype(np.float32)

    def decode(self, classes: np.ndarray, chains: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The best labels of all chains: Viterbi, one step for all chains that are so long; ties go to the first label."""
        n = len(classes)
        if not n:
            return np.empty(0, dtype=np.int8)
        emit = np.zeros((n, len(LABELS)), dtype=np.float32)
        for j, c in enumerate(self.shifted(classes, chains)):
            emit += table[j][c]
        begin = np.flatnonzero(np.append(True, chains[1:] != chains[:-1]))
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        move = (self.pair + self.banned).astype(np.float32)
        back = np.zeros((n, len(LABELS)), dtype=np.int8)
        score = (self.start + self.banned_start).astype(np.float32) + emit[begin]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # chains with that many words
        for t in range(1, size[0]):
            a = live[t]
            here = begin[:a] + t
            new = np.empty((a, len(LABELS)), dtype=np.float32)
            for y in range(len(LABELS)):
                best, source = score[:a, 0] + move[0, y], np.zeros(a, dtype=np.int8)
                for x in range(1, len(LABELS)):
                    if move[x, y] > -1e3:
                        other = score[:a, x] + move[x, y]
                        source[other > best] = x
                        best = np.maximum(best, other)
                new[:, y] = best
                back[here, y] = source
            score[:a] = new + emit[here]
        out = np.zeros(n, dtype=np.int8)
        label = np.zeros(len(begin), dtype=np.int8)
        for t in range(size[0] - 1, -1, -1):
            a = live[t]
            ended = size[:a] == t + 1
            label[:a][ended] = score[:a][ended].argmax(1)
            here = begin[:a] + t
            out[here] = label[:a]
            label[:a] = back[here, label[:a]]
        return out


class Classes(dict):
    """Words to 2 * class + (1 if the chain ends after it). Words with the same known features and possible labels are one class; a line's end is
    class 0, which has none, and ends the chain."""

    def __init__(self, field: Field):
        self.field = field
        self.numbers: dict[tuple, int] = {((0,) * Field.STREAMS, (0.0,) * len(LABELS)): 0}
        self.weights = np.empty((0, 0, 0), np.float32)

    def __missing__(self, word: bytes) -> int:
        if word == b"\0":
            n = 1
        else:
            text = word.decode("utf-8", "replace")
            own = self.field.streams(text)
            n = 2 * self.numbers.setdefault((self.field.known(own), tuple(self.field.may_be(own))), len(self.numbers)) + ends_chain(text, own)
        self[word] = n
        return n

    def table(self) -> np.ndarray:
        if self.weights.shape[1] < len(self.numbers):
            self.weights = self.field.table(*map(list, zip(*self.numbers, strict=True)))
        return self.weights


EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns of the base kinds. A look behind spares starts within a run of digits, of which none can match if the first doesn't.
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\n|[^\x20\x09-\x0D]+")
DIGITS = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@host: only what stands around an @ can match."""
    last, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > last and text[low - 1] in EMAIL_LOCAL:
            low -= 1
        m = EMAIL_HOST.match(text, at) if low < at else None
        if m:
            yield low, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def patterns(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind as listed here and start."""
    out = [("email", a, b) for a, b in emails(text)]
    # a part of over 20 digits is over 255 in any case
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-20:]) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(DIGITS.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def is_name(words: list[str]) -> bool:
    return len(words) <= NAME_WORDS and any(len(w.strip(EDGES + ".")) > 1 for w in words)


@lru_cache
def trained(table: str) -> Field:
    """The field of a table, trained once on the driver; executors are sent its weights."""
    return Field(list(labelled(table)))


def entities(texts: list[bytes], memory: Classes) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of what the field finds in each text, in order."""
    if len(memory) > REMEMBERED:
        memory.clear()
    codes = [np.fromiter(map(memory.__getitem__, w), np.int64, len(w)) for w in (t.replace(b"\n", b" \0 ").split() for t in texts)]
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
    ends = flat & 1
    ends[np.cumsum(sizes)[sizes > 0] - 1] = 1
    labels = memory.field.decode(flat >> 1, np.cumsum(ends) - ends, memory.table())
    out, low = [], 0
    for text, n in zip(texts, sizes, strict=True):
        own, found = labels[low : low + n], []
        low += n
        if own.any():
            text = text.decode("utf-8", "replace")
            for m, y in zip(TOKEN.finditer(text), own, strict=True):
                if not y or m[0] == "\n":
                    continue
                # quotes, commas and stops around the words aren't part of them
                a, b = m.start(), m.end()
                while a < b - 1 and text[a] in EDGES:
                    a += 1
                while b > a + 1 and text[b - 1] in EDGES + ".":
                    b -= 1
                kind = KINDS[(y - 1) // 2]
                if y % 2 == 0 and found and found[-1][0] == kind:
                    found[-1] = (kind, found[-1][1], b)
                else:
                    found.append((kind, a, b))
        # a longer run of capitals is a heading or a list, and letters by themselves are no name
        out.append([x for x in found if x[0] != "name" or is_name(text[x[1] : x[2]].split())])
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: str = LABELLED) -> DataFrame:
    """One row per input row: id and found, an array of (kind, start, end, base) in code points: the base kinds email, ip, card and phone in
    this order, then what the field finds beside them, kinds name and id, each kind by start.

    A chain of the field is a line or a sentence in it. Null and empty texts have no findings; rows that repeat get the same ones; an empty table gives an
    empty result. A map over rows: nothing is shuffled, one block of texts is held at a time, and other columns are not read.
    """
    field, key = trained(table), ("field", zlib.crc32(table.encode()))

    def make():
        memory = held(key, lambda: Classes(field))

        def f(_, texts):
            texts = [t or b"" for t in texts]
            out = []
            for text, more in zip(texts, entities(texts, memory), strict=True):
                base = patterns(text.decode("utf-8", "replace"))
                beside = [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]
                rows = [(*x, True) for x in base] + [(*x, False) for x in sorted(beside, key=lambda x: (KINDS.index(x[0]), x[1]))]
                out.append([{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in rows])
            return [out], None

        return f

    return map_texts(docs, [F.col(id_col)], text_col, make, "found array<struct<kind: string, start: int, end: int, base: boolean>>").withColumnRenamed("_k0", id_col)
