"""Personal data: patterns with checks, and a linear-chain CRF for what patterns miss.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of the kind's
pattern, those failing the kind's check dropped.

Method.  A linear-chain conditional random field labels words (B and I of each kind, or O)
from their shape: letters, capitals and digits folded, runs shortened, with neighbours'
shapes, digit counts and a few cue words.  It is trained by gradient ascent on the small
labelled table below (written forms that the patterns miss, such as "name at host dot
com", an address with bracketed dots, a card number in unusual groups or a telephone
number without a plus sign, and look-alikes that are none), and decoded by Viterbi in
padded numpy batches.  A span of the CRF is drawn to the part of it that is written like
its kind, and added if there is one, it passes the kind's check and overlaps no base span.
Passwords and keys are labelled too; they are no kind of `spans` and have columns of their
own (n_secrets, secrets).

Chains are decoded in padded batches of bounded size, a long one alone and in segments, so a text
that is all numbers takes room in proportion to its own words.

Chains are the words within REACH words of a trigger (a digit, @, or a cue such as "(at)"
or "dot").  No span that its kind's check accepts reaches further: its words hold digits,
"at" or "dot" themselves, or stand beside one that does; what is beyond is outside.

Cases: null text is empty; an empty text has no spans and the digest of no bytes; very long
texts are searched whole in linear time (anchored searches), and so are very long numbers;
repeated rows get equal spans; of labellings with equal scores the one with the earlier
label counts; an empty table gives no rows; extra columns are ignored by
`find` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm._spark import bound_batches, table, text_of

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
LABELS = ["O"] + [f"{p}-{k}" for k in (*KINDS, SECRET) for p in "BI"]
FEATURE_BITS = 13
REACH = 4
#: Chains decoded together, and words of a padded batch at most; a longer chain goes alone, its words looked at SEGMENT at a time.
BATCH = 512
CELLS = 1 << 15
SEGMENT = 1 << 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a start inside a run of digits cannot match where the run's first digit does not
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]|(?:^|[^A-Za-z])dot(?:[^A-Za-z]|$)", re.I)
_AT_HOST = re.compile(r"at\s+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2}", re.I | re.A)
_TRIGGER_TEXT = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]|\bdot\b|\b" + _AT_HOST.pattern, re.I | re.A)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    """Whether all parts (digits, of any length) are at most 255."""
    return all(len(p) < 3 or len(p) == 3 and p <= "255" for p in (p.lstrip("0") for p in parts))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, in order of start and then kind."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if _octets(m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the labelled table: [kind:words] marks a span ----------------------------------------

LABELLED = """
Please write to [email:john.smith at example dot com] for details.
You can reach me at [email:anna (at) mail (dot) org] or later.
Mail [email:support [at] company [dot] net] with questions.
Her address is [email:mary_lee AT post DOT de], he said.
Contact: [email:info(at)example.com] today.
Send it to [email:billing[at]shop.co.uk] please.
Write [email:peter dot jones at mail dot example dot com] soon.
the list is [email:news at lists dot example dot org] for now
Mail [email:bob at example dot com] now.
or mail [email:kim at host dot net] now
ask [email:sam at site dot io] about it
[email:lee at uni dot edu] answers
Call [phone:(487) 555-7209] before noon.
Call [phone:487-555-7209] after five.
Phone [phone:487.555.7209] or leave a note.
Tel [phone:(020) 7946 0958] in the day.
ring [phone:0171 4960 123] for the office
my number is [phone:(212) 555 0147] ok
fax [phone:212-555-0199] and mail
Telefon [phone:030 2345 6789] ab neun Uhr.
Appelez le [phone:01 42 68 53 00] demain.
Llame al [phone:91 555 01 23 45] por favor.
mobile [phone:07700 900123] works too
write to [email:tom at example.com] today
Please mail [email:eva at shop.org] for it.
or reach [email:nina at host.example.net] instead
Look at config.py and at main.go first.
The talk is at docs.python for now.
We met at the dot of nine in the hall.
the meeting at 10 dot was long
The dot com years were short and odd.
He stood at the line and drew a dot there.
it was at noon that the first dot was seen
On 2024-01-31 the order 48213 was sent.
The price rose from 12.50 to 13.75 in 2019.
Version 3.11.2 fixes 14 errors of version 3.10.
In 1999 and 2001 there were 3 of them.
Pages 120-135 of volume 7 are missing.
licensed under the GNU General Public License, version 3.
order 123 456 789 items in 3 lots
Order no 1234567890 has 25 items at 4.99 each.
It weighs 12 kg and costs 300 euros.
See section 4.2.1 and table 12 for the figures.
The score was 3-2 after 90 minutes.
article 5 of 16 says 100 percent
ISBN 978-3-16-148410-0 was printed in 1994.
room 1204 on floor 12 is open
Ratio 16:9 and size 1920x1080 are common.
the host [ip:192 dot 168 dot 1 dot 10] is down
block [ip:203[.]0[.]113[.]7] at once
from [ip:198.51.100[.]23] came the mail
seen at [ip:10 (dot) 0 (dot) 0 (dot) 12] today
ping [ip:172 [dot] 16 [dot] 254 [dot] 1] twice
server [ip:8 . 8 . 8 . 8] answers
card [card:4111.1111.1111.1111] was used
pay with [card:5555/5555/5555/4444] today
number [card:4012_8888_8888_1881] expires soon
the visa [card:3782 - 822463 - 10005] is valid
charge [card:4000:0566:5566:5556] for it
call [phone:4875557209] before noon
phone [phone:2125550147] and ask
his mobile is [phone:07700900123] at home
call [phone:3105550178]
ring [phone:6175550133] please
tel [phone:02079460958] in the day
The sum of 1 dot 5 and 2 dot 5 is 4 dot 0.
chapter 3 dot 2 follows
ip 300 dot 300 dot 1 dot 1 is none
version 10 . 2 . 1 is out
build 20240131.1234.5678.0001 passed
codes 1234/5678/9012/3456 failed
the invoice 4875557209 is paid
serial 2125550147 of the engine
they met at home dot and line
She is good at chess dot games.
token = [secret:"9742a250774262d69ad6a86100194ed53da5a0ef"] was found here.
key = [secret:"a4a14da4dc9b206c0209041b0961df015c66b4f9"] is secret.
and [secret:password=9f1c02ab77de410c55] in the text
the line [secret:password=00ab41c9e2d7f6a813] stands alone
with [secret:ABCD7QX2M4NP8RS5TV1W] of the account
old [secret:QKEYZ3LM5NB7VC2XW9RT] was revoked
api_key: [secret:sk9f8a7b6c5d4e3f2a1b0c] in the file
[secret:ghk_1a2B3c4D5e6F7g8H9i0J] leaked
found [secret:QRSTUVWABCDEFGHJKLM7] in it
commit 9f1c02a fixes it
word internationalisation2024 is long
call [phone:415 555 2671] tonight
phone [phone:212 555 0147] and ask for Lee
tel [phone:312 555 0188] or come by
my mobile number is [phone:646 555 0101] now
results 123 4567 8901 were seen
rows 12 34 56 78 90 here
totals: 123 456 7890
in 2019 2020 2021 it rose
born 12 03 1984 in 5551
Section 10 . 2 . 3 . 4 of the act
chapter 4 . 1 . 2 . 3 is short
see section 7 . 1 . 2 . 9 below
write me: [email:dan(at)post(dot)se]
mail [email:pat@home dot net] or call
it is [email:kim@shop (dot) org] now
card [card:4111|1111|1111|1111] was used
bitte an [email:Info at Firma dot DE] senden
all of it goes to [email:Press at Paper dot UK] instead
"""


#: Written forms and the places they stand in; two of three pairs of them join the table, the others are for measuring.
FORMS = ("email:lena at post dot org", "email:tom.ray (at) shop (dot) net", "email:help [at] desk [dot] com", "email:office(at)school.edu", "email:maria at fastmail dot biz", "email:ann_b at corp dot co dot uk", "email:joe {at} web {dot} ch", "email:x.y at mail dot firm dot info", "phone:(312) 555-0188", "phone:(646) 555 0101", "phone:312-555-0122", "phone:312.555.0166", "phone:0161 4960 777", "phone:01 45 22 33 44", "phone:0161-496-0321", "ip:10 dot 20 dot 30 dot 40", "ip:192[.]0[.]2[.]146", "ip:172 (dot) 31 (dot) 5 (dot) 9", "ip:203 . 0 . 113 . 99", "ip:198[dot]51[dot]100[dot]7", "ip:45[.]76[.]128[.]201", "ip:5 dot 9 dot 88 dot 17", "ip:91.12.7[.]8", "ip:192 . 0 . 2 . 77", "ip:172 . 16 . 0 . 250", "ip:11 dot 2 dot 3 dot 4", "ip:185.220[.]100[.]240", "email:pia at home dot fr", "email:ned<at>mail<dot>net", "email:ivo{at}lab{dot}edu", "card:4242.4242.4242.4242", "card:4916/3385/0608/2832", "card:5105_1051_0510_5100", "card:6011:1111:1111:1117", "card:4532 - 0151 - 1283 - 0366", "secret:password=41d0c9aa7be35f2e18", 'secret:"5f8d04c3b1a29e7761f0c2d3e4a5b69788990011"', "secret:WXYZ4T7K2M9QH5RB8LCA", "secret:MNOPQ2RSTUVWXYZA6BCD", "secret:KLMNOPQRS7TUVWXYZABC", "phone:030 1234 567", "phone:0711 234 5678", "phone:020 7123 4567", "phone:04 91 22 33 44", "phone:089 3216 540", "ip:10 . 0 . 0 . 138", "ip:192 . 168 . 1 . 20", "ip:8[.]8[.]4[.]4", "ip:151[.]101[.]1[.]69")
PLACES = ("please call or write {} today", "{}", "you find it under {}, as always", "then {} was given to us.", "for more: {}", "the old one, {} is gone", "and {} on the last page", "reach us: {} or come by", "it was {} that she used", "Siehe {} und mehr", "voir {} pour cela", "{} is it", "mail {} ok", "the server {} down", "the box at {} failed", "from {} all day", "con {} en la casa", "chez papa {} ici.")


#: Groups of numbers that are no telephone numbers where nothing says so, and places without such a word.
NUMBERS = ("123 4567 8901", "12 34 56 78 90", "123 456 7890", "2019 2020 2021", "12 03 1984 5551", "48 213 755 90", "1 024 768 2048", "3 14 159 2653", "100 200 300 400", "55 812 4410 9", "7 001 234 567", "31 12 1999 2000", "16 32 64 128 256", "410 220 3300 12", "1000 2000 3000", "640 480 800 600")
PLAIN = ("results {} were seen", "{}", "rows {} here", "totals: {}", "then {} was given to us.", "it was {} that she used", "and {} on the last page", "the old one, {} is gone", "con {} en la casa", "{} is it", "voir {} pour cela", "in {} it rose", "Siehe {} und mehr", "you find it under {}, as always", "lots {} sold out")


def table_lines(held: int = 0) -> list[str]:
    """The table; with held, every held-th written form (of any kind, and of the numbers) is left out of it as a whole."""
    trained = lambda i: not held or i % held
    more = [place.format(f"[{form}]") for i, form in enumerate(FORMS) for j, place in enumerate(PLACES) if (i + j) % 3 and trained(i)]
    plain = [place.format(form) for i, form in enumerate(NUMBERS) for j, place in enumerate(PLAIN) if (i + j) % 2 and trained(i)]
    return LABELLED.strip().split("\n") + more + plain


def labelled(held: int = 0) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each sentence of the table."""
    out = []
    for line in table_lines(held):
        words, labels = [], []
        for part in re.split(r"(\[(?:email|ip|card|phone|secret):(?:[^\[\]]|\[at\]|\[dot\]|\[\.\])*\])", line):
            m = re.match(r"\[(email|ip|card|phone|secret):(.*)\]\Z", part)
            for k, w in enumerate((m[2] if m else part).split()):
                if not m and words and k == 0 and part[0] != " ":  # punctuation stuck to a span
                    words[-1] += w
                    continue
                words.append(w)
                labels.append("O" if not m else f"{'I' if k else 'B'}-{m[1]}")
        out.append((words, labels))
    return out


def shape(word: str) -> str:
    """Folded characters, runs cut at 4: X capitals, x other letters, d digits."""
    out, last, run = [], "", 0
    for c in word[:40]:
        c = "d" if "0" <= c <= "9" else "X" if "A" <= c <= "Z" else "x" if c.isalpha() else c
        run = run + 1 if c == last else 1
        if run <= 4:
            out.append(c)
        last = c
    return "".join(out)


_CUES = frozenset("at dot (at) [at] (dot) [dot] {at} {dot} call phone tel telefon ring fax mobile number mail write contact address appelez llame version page pages order no isbn token key password ip host server card visa chapter invoice serial codes build".split())
_KEY = re.compile(r"[A-Za-z0-9+/_-]{12,}")
_TURN = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")


def _stuff(word: str) -> str:
    """What a word is made of: digits, a long mixture of digits and letters, capitals with digits, letters, numbers or anything else."""
    bare = word.strip("\"',;:!?()[]{}<>*#%&$")
    if bare.isdigit():
        return "digits"
    for m in _KEY.findall(bare):
        if len(_TURN.findall(m)) >= 3:
            return "key"
        if len(m) >= 16 and m.isupper() and m.isalnum() and not m.isalpha():
            return "capitals"
    return "letters" if bare.isalpha() else "number" if bare and not re.search("[A-Za-z]", bare) else "other"


def _outline(word: str) -> str:
    """A word with each run of digits as d and of letters as x."""
    return _RUN.sub(lambda m: "d" if m[0][0].isdigit() else "x", word.strip(",;:!?\"'")[:80])


def _own(word: str) -> tuple[str, ...]:
    return _features_of(word) if len(word) <= 64 else _features_of.__wrapped__(word)  # long words are not kept


@lru_cache(1 << 15)
def _features_of(word: str) -> tuple[str, ...]:
    low = word.lower().strip(".,;:!?\"'")
    digits = sum("0" <= c <= "9" for c in word)
    return ("s=" + shape(word), "d=%d" % min(digits, 11), "w=" + (low if low in _CUES else "-"), "k=" + _stuff(word[:200]), "o=" + _outline(word[:200]), "p=" + word[:1] if not word[:1].isalnum() else "p=a", "e=" + word[-1:] if not word[-1:].isalnum() else "e=a", "l=%d" % min(len(word), 12), "z=%d" % (word[:1] == "0" or word[:2] == "(0"))


@lru_cache(1 << 17)
def _cell(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") & ((1 << FEATURE_BITS) - 1)


def features(words: list[str]) -> list[list[int]]:
    """Cells of every word: its own features, and its neighbours' up to two words away."""
    own = [_own(w) for w in words]
    out = []
    for k in range(len(words)):
        sides = [own[k + d][2] if 0 <= k + d < len(words) else "none" for d in (-1, 1)]
        got = ["b", *own[k], "|".join((own[k][3], *sides)), "|".join((own[k][2], *(own[k + d][3] if 0 <= k + d < len(words) else "none" for d in (-1, 1))))]
        for d in (-3, 3):
            if 0 <= k + d < len(words):
                got.append(f"{d}{own[k + d][2]}")
        for d in (-2, -1, 1, 2):
            if 0 <= k + d < len(words):
                got += [f"{d}{f}" for f in (*own[k + d][:4], own[k + d][8])]
            else:
                got.append(f"{d}none")
        out.append([_cell(f) for f in got])
    return out


class CRF:
    """Weights of cells by label, of label pairs and of first labels."""

    def __init__(self, cells: np.ndarray, pairs: np.ndarray):
        self.cells, self.pairs = cells, pairs

    @staticmethod
    def allowed() -> np.ndarray:
        """0 where a label may follow another, else a large penalty: I follows B or I of its kind."""
        n = len(LABELS)
        out = np.zeros((n + 1, n))  # the last row is the start
        for b, label in enumerate(LABELS):
            if label[0] == "I":
                out[:, b] = -1e4
                out[[LABELS.index("B" + label[1:]), b], b] = 0
        return out

    @classmethod
    def fit(cls, sentences: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.1, ridge: float = 0.02) -> CRF:
        """Gradient ascent (Adam) on the penalised conditional likelihood, all sentences at once."""
        n = len(LABELS)
        sentences = sorted(sentences, key=lambda s: -len(s[0]))  # the longest first: those still going at any word are a prefix
        longest = len(sentences[0][0])
        feats = [features(w) for w, _ in sentences]
        gold = np.full((len(sentences), longest), -1)
        for i, (_, labels) in enumerate(sentences):
            gold[i, : len(labels)] = [LABELS.index(x) for x in labels]
        rows, cells = zip(*[(i * longest + t, c) for i, f in enumerate(feats) for t, own in enumerate(f) for c in own], strict=True)
        rows, cells = np.array(rows), np.array(cells)
        weight, pairs = np.zeros((1 << FEATURE_BITS, n)), np.zeros((n + 1, n))
        used = np.unique(cells)
        word_at, word = np.flatnonzero(np.diff(rows, prepend=-1)), np.unique(rows)  # rows ascend
        by_cell = np.argsort(cells, kind="stable")
        cell_at, rows_by_cell = np.flatnonzero(np.diff(cells[by_cell], prepend=-1)), rows[by_cell]
        moments = [np.zeros((len(used), n)), np.zeros((len(used), n)), np.zeros_like(pairs), np.zeros_like(pairs)]
        mask = gold >= 0
        going = [*mask.sum(0), 0]
        truth = np.zeros((len(sentences) * longest, n))
        truth[np.flatnonzero(mask.ravel()), gold[mask]] = 1
        gold_pairs = np.zeros_like(pairs)
        np.add.at(gold_pairs, (np.full(len(sentences), n), gold[:, 0]), 1)
        for t in range(1, longest):
            both = mask[:, t]
            np.add.at(gold_pairs, (gold[both, t - 1], gold[both, t]), 1)
        barrier = cls.allowed()
        for step in range(1, rounds + 1):
            emit = np.zeros((len(sentences) * longest, n))
            emit[word] = np.add.reduceat(weight[cells], word_at)
            emit = emit.reshape(len(sentences), longest, n)
            move = pairs + barrier
            alpha = [move[n] + emit[:, 0]]
            for t in range(1, longest):
                alpha.append(_logsum(alpha[-1][: going[t], :, None] + move[:n], 1) + emit[: going[t], t])
            total = np.concatenate([_logsum(alpha[t][going[t + 1] :], 1) for t in range(longest - 1, -1, -1)])
            beta = [np.zeros((going[-2], n))]
            for t in range(longest - 1, 0, -1):
                b = np.zeros((going[t - 1], n))
                b[: going[t]] = _logsum(move[:n] + (emit[: going[t], t] + beta[0])[:, None, :], 2)
                beta.insert(0, b)
            expect = np.zeros((len(sentences), longest, n))
            for t in range(longest):
                expect[: going[t], t] = np.exp(alpha[t] + beta[t] - total[: going[t], None])
            pair_expect = np.zeros_like(pairs)
            pair_expect[n] = expect[:, 0].sum(0)
            for t in range(1, longest):
                k = going[t]
                pair_expect[:n] += np.exp(alpha[t - 1][:k, :, None] + move[:n] + (emit[:k, t] + beta[t])[:, None, :] - total[:k, None, None]).sum(0)
            off = truth - expect.reshape(-1, n)
            grad = np.add.reduceat(off[rows_by_cell], cell_at)  # of the used cells
            for k, (param, g) in enumerate(((weight, grad - ridge * weight[used]), (pairs, gold_pairs - pair_expect - ridge * pairs))):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if k == 0:
                    param[used] += change
                else:
                    param += change
        return cls(weight.astype(np.float32), (pairs + barrier).astype(np.float32))

    def emissions(self, words: list[str], low: int, high: int) -> np.ndarray:
        """Scores of the labels of words low to high; features look three words to either side."""
        first = max(low - 3, 0)
        return np.stack([self.cells[c].sum(0) for c in features(words[first : high + 3])[low - first : high - first]])

    def decode(self, chains: list[list[str]]) -> list[list[int]]:
        """The best labels of each chain (Viterbi), chains of like length in one padded batch of at most CELLS words."""
        out: list[list[int]] = [[]] * len(chains)
        order = sorted((k for k in range(len(chains)) if chains[k]), key=lambda k: len(chains[k]))
        while order:
            take = 1
            while take < min(BATCH, len(order)) and (take + 1) * len(chains[order[take]]) <= CELLS:
                take += 1
            some, order = order[:take], order[take:]
            for k, path in zip(some, self._decoded([chains[k] for k in some]), strict=True):
                out[k] = path
        return out

    def _decoded(self, chains: list[list[str]]) -> list[list[int]]:
        n, size = len(LABELS), np.array([len(c) for c in chains])
        longest = int(size.max())
        back = np.zeros((longest, len(chains), n), np.int8)
        score = np.zeros((len(chains), n), np.float32)
        for low in range(0, longest, SEGMENT):
            high = min(low + SEGMENT, longest)
            emit = np.zeros((len(chains), high - low, n), np.float32)
            for i, words in enumerate(chains):
                if low < len(words):
                    own = self.emissions(words, low, min(high, len(words)))
                    emit[i, : len(own)] = own
            for t in range(low, high):
                if not t:
                    score = self.pairs[n] + emit[:, 0]
                    continue
                ways = score[:, :, None] + self.pairs[:n]
                back[t] = ways.argmax(1)
                score = np.where((t < size)[:, None], ways.max(1) + emit[:, t - low], score)
        out, last = [], score.argmax(1)
        for i in range(len(chains)):
            label, path = int(last[i]), np.zeros(size[i], np.int8)
            for t in range(int(size[i]) - 1, -1, -1):
                path[t] = label
                label = int(back[t, i, label])
            out.append(path.tolist())
        return out


@lru_cache(1)
def fitted() -> CRF:
    """The field of the whole table: fitted once in a process."""
    return CRF.fit(labelled())


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """Word spans of the chains of a text: the words within REACH words of a trigger."""
    if not _TRIGGER_TEXT.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    until = -1
    for k, (a, b) in enumerate(words):
        if _TRIGGER.search(text[a:b]) or b - a == 2 and _AT_HOST.match(text, a):
            first = max(k - REACH, 0)
            if first > until:
                out.append([])
                until = first - 1
            last = min(k + REACH, len(words) - 1)
            out[-1] += words[until + 1 : last + 1]
            until = last
    return out


_AT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s?@\s?)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s*\.\s*)"
_TIGHT_DOT = _DOT.replace(r"|\s*\.\s*", r"|\.")
#: How the kinds are written out; the match is what is added.
_WRITTEN = {
    "email": re.compile(rf"[A-Za-z0-9_%+-]+(?:{_TIGHT_DOT}[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_TIGHT_DOT}[A-Za-z0-9-]+)*{_TIGHT_DOT}[A-Za-z]{{2,}}\b", re.I | re.A),
    "ip": re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I | re.A),
    "card": re.compile(r"(?<![0-9])[0-9](?:(?:[ ./_:|-]| [-\u2013] )?[0-9]){13,18}(?![0-9])", re.A),
    "phone": re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9](?![0-9])", re.A),
    SECRET: re.compile(r"[A-Za-z0-9+/_-]{12,}", re.A),
}


def _checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The part of text[start:end] that is written like its kind, if it passes the kind's check."""
    for m in _WRITTEN[kind].finditer(text, start, end):
        digits = re.sub(r"[^0-9]", "", m[0])
        if kind == "email":
            ok = True
        elif kind == "ip":
            ok = _octets(re.findall("[0-9]+", m[0]))
        elif kind == "card":
            ok = luhn(digits)
        elif kind == "phone":
            ok = 10 <= len(digits) <= 15
        else:
            ok = bool(digits) and len(digits) < len(m[0]) and bool(re.search("[A-Za-z]", m[0]))
        if ok:
            return m.span()
    return None


def added_spans(texts: list[str], base: list[list[tuple[int, int, str]]], crf: CRF) -> list[list[tuple[int, int, str]]]:
    """Spans of the CRF that overlap no base span, for each text."""
    found = [(i, c) for i, text in enumerate(texts) for c in chains_of(text)]
    labels = crf.decode([[texts[i][a:b] for a, b in c] for i, c in found])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (i, chain), path in zip(found, labels, strict=True):
        k = 0
        while k < len(path):
            label = LABELS[path[k]]
            j = k + 1
            if label[0] == "B":
                while j < len(path) and LABELS[path[j]] == "I" + label[1:]:
                    j += 1
                span = _checked(texts[i], chain[k][0], chain[j - 1][1], label[2:])
                if span and not any(span[0] < e and s < span[1] for s, e, _ in base[i]):
                    out[i].append((*span, label[2:]))
            k = j
    return out


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def split_secrets(spans: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(spans of the four kinds, secrets)."""
    return [s for s in spans if s[2] != SECRET], [s for s in spans if s[2] == SECRET]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", crf: CRF | None = None) -> DataFrame:
    """doc_id, numbers of base spans, base_sha256, spans (all), n_added, n_secrets, secrets and n_found (spans and secrets) for every row."""
    bound_batches(docs.sparkSession)
    crf = crf or fitted()
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    body = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(f"`{text}`").alias("_text"))
    schema = T.StructType([body.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_secrets", T.LongType()), T.StructField("secrets", T.StringType()), T.StructField("n_found", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                more, secrets = zip(*map(split_secrets, added_spans(texts, base, sent.value)), strict=True)
                every = [sorted(b + m, key=lambda s: (s[0], KINDS.index(s[2]))) for b, m in zip(base, more, strict=True)]
                counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array(map(_written, every), pa.string()), pa.array(map(len, more), pa.int64()), pa.array(map(len, secrets), pa.int64()), pa.array(map(_written, secrets), pa.string()), pa.array([len(a) + len(b) for a, b in zip(every, secrets, strict=True)], pa.int64())], schema.names)

    return body.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", crf: CRF | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets; all columns stay and null stays null."""
    bound_batches(docs.sparkSession)
    crf = crf or fitted()
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            some = [t or "" for t in texts]
            base = [base_spans(t) for t in some]
            out = []
            for t, whole, b, m in zip(texts, some, base, added_spans(some, base, sent.value), strict=True):
                last, parts = 0, []
                for s, e, k in sorted(b + m):
                    if s >= last:
                        parts += [whole[last:s], f"[{k}]"]
                    last = max(last, e)
                out.append(None if t is None else "".join(parts) + whole[last:])
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
