"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find what is written in one standard way. The field is trained from a small labelled
table (:func:`labelled`, or one that a caller gives) and adds what context and shape show: national
telephone numbers, spelled-out addresses, IPv6, cards with odd separators (the sum of their digits is
checked). A word is known to the field by its shape, by a coarser one where that is new, or as one
of the cues that stand before personal data in the table, so a text becomes a row of small numbers, and Viterbi decodes many texts side by
side in numpy. A span of the field that touches a span of a pattern is dropped: the latter stays.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import WORD, text_of, tidy

KINDS = ("email", "ip", "card", "phone")
# Label 0 is outside; each kind has a label for its first word and one for those that follow.
LABELS = 1 + 2 * len(KINDS)

# The patterns of the contract. Atomic groups take away only useless retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORDS = re.compile(WORD)

# Sentences whose personal data stands in braces after its kind.
LABELLED = """
call me at {phone (212) 555-0187} after six
our office number is {phone (305) 555-0142} and we open early
phone {phone 415-555-0199} for details
tel. {phone 030 5550 1234} or write to us
tel: {phone 0171 555 20 28}
fax {phone 312.555.0175} is still in use
reach her on {phone 555-0123} today
telephone {phone (044) 668 18 00} , ask for the desk
call {phone 1-800-555-0100} toll free
phone {phone (617) 555-0110}
the number {phone 555-0136} was busy
call {phone 020 7946 0958} in London
mobile {phone 07700 900123} , evenings only
tel {phone 0221/5550-143} in the morning
phone {phone 01 55 50 12 34} in paris
call {phone 06-5550-1234} or {phone 310/555-0166} soon
my cell is {phone 646.555.0123} now
ring {phone 0161 496 0123} at noon
whatsapp {phone 0049 151 55501234} works too
dial {phone 00 44 20 7946 0321} from abroad
phone {phone +44 20 7946 0000} now
tel {phone +1 (202) 555-0143} in town
call {phone +49 30 901820} before noon
write to {email anna@example.org} about it
mail {email j.smith@mail.example.com} for the list
contact {email info@example.net} or visit
write to {email john (at) example (dot) com} please
mail {email mary [at] example [dot] org} instead
email {email peter at example dot net} for help
contact {email sales(at)example.com} today
reach us by email {email help[at]example.org}
mail {email paul_at_example_dot_org} if you can
email {email ann-at-example-dot-com} for a list
mail to {email kim <at> example <dot> net} today
contact {email team(at)example(dot)com} or visit
send it to {email lee AT example DOT org} now
from host {ip 192.0.2.17} last night
the server {ip 203.0.113.9} is down
ip {ip 2001:db8:0:0:1:0:0:7} was seen
address {ip fe80::1ff:fe23:4567:890a} answered
host {ip 2001:db8::8a2e:370:7334} replied
the server {ip 2001:0db8:0000:0000:0000:ff00:0042:8329} is down
from {ip 192[.]0[.]2[.]44} last night
requests came from {ip 198.51.100[.]7} again
from {ip fe80::1} to {ip 2001:db8:a::2} at night
pay with card {card 4111 1111 1111 1111} please
card number {card 5500-0000-0000-0004} expired
card {card 4012.8888.8888.1881} was used
visa {card 4111.1111.1111.1111} on file
card {card 4111/1111/1111/1111} was charged
my card is {card 5555_5555_5555_4444} and works
paid by {card 4242 / 4242 / 4242 / 4242} yesterday
card: {card 4000 - 0566 - 5566 - 5556} ok
he paid with {card 5105.1051.0510.5100} there
the year 1984 was long and 2001 longer
version 2.0 replaced version 1.4.2 in may
licensed under version 3 or later
released on 2024-01-05 at 12:30 and again on 05.01.2024
it costs 12.50 or 1,200.00 in all
chapter 4 page 112 line 7
there were 250 people and 12 dogs
the order 7300518264410927 was lost
number 1234567812345678 is no card
invoice 0000111122223334 of march
part 555-12 is out of stock
room 101 and room 202 are free
between 10 and 20 percent of 3000
section 3.2.1 says so
the ratio is 3:2 or 16:9
meet at noon (not before) on monday
she looked at the dot on the map
he sat at home and ate
the at sign and the dot
isbn 978-3-16-148410-0 is in print
the score was 21-19 and 21-17
in 1999-2004 and 2010-2015
model 12-345-67 and model 88.12
a b c d e f g
one word ### another $$$ word %%% end
well-known facts and/or hearsay it's e.g. here
thing### other$$$ more%%% yet&&& last*** done
"quoted" (aside) [note] <tag> a/b c_d e=f
NOISE!! MORE!! NOISE!!
item | next | third | end
x1 y2 z3 b4u 2nd 3rd 4th 5% 6kg 7pm #8
$12.50 10% 20-30 1/2 3x4 5+5 1,000 2e10
item | 12 | 34 | 56 | total
released under the mit license in 2019 .
see figure 12 (page 30) and table 4
the sum of 1 2 3 4 5 6 7 8 is 36
at 5 he left and at 6 he came
call me later
call 3 people and 12 friends
the phone costs 299 or 349.00 in all
at 12:30:45 and 2024-01-05T10:20:30 it ran
the ratio 1:2:3 and the mac 00:1a:2b:3c:4d:5e are not it
commit 9fceb02 and key a1b2c3d4e5f6 were lost
look at the dot-com and the at-sign
the table 12/34/56 and the date 01/02/2024
the code 1234-5678 and the sum 1.234.567,89
version 10.15.7.2 of 2023.11.02 is out
to to to to to to
at at at at at at at the end
he went to to the door at at once
the phone is old
write a card to them
a card of 300 grams
our server is new and the host is kind
email is slow
"""

# Words that announce each kind, ways to write it, and numbers that these words announce as well.
_ANNOUNCED = {
    "phone": (
        "call|phone|tel|tel.|telephone|fax|mobile|cell|dial|ring|phone is|cell is|telephone is|fax at",
        "(212) 555-0187|415-555-0199|312.555.0175|310/555-0166|6465550123|030 5550 1234|0345-5550142"
        "|0171 555 20 28|07700 900123|0221/5550-143|1-800-555-0100|01 55 50 12 34|0711 5550 143",
        "3 people|12 times|2 or 3 of them|at 10:30|299 each|in 2019",
    ),
    "card": (
        "card|visa|mastercard|card number|card is|paid with|card:",
        "4111.1111.1111.1111|5555/5555/5555/4444|4242_4242_4242_4242|4000 - 0566 - 5566 - 5556"
        "|3714.496353.98431|4012 / 8888 / 8888 / 1881",
        "of 300 grams|12 of 40|in 2020|no. 7",
    ),
}


def labelled() -> str:
    """The sentences of ``LABELLED``, and every announcing word with some of the ways of writing."""
    lines = [LABELLED.strip()]
    for kind, (cues, ways, others) in _ANNOUNCED.items():
        ways, others = ways.split("|"), others.split("|")
        for i, cue in enumerate(cues.split("|")):
            for j in range(4):
                lines.append(f"my {cue} {{{kind} {ways[(4 * i + j) % len(ways)]}}} is there")
            lines.append(f"the {cue} {others[i % len(others)]} was there")
    return "\n".join(lines)


_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_EDGES = b".,;:!?\"'"
_BRACKETS = b"()[]{}<>*_-"
_SPELLED = re.compile(
    r"[A-Za-z0-9.+%-]+?[\W_]+at[\W_]+[A-Za-z0-9-]+(?:(?:\.|[\W_]+dot[\W_]+)[A-Za-z0-9-]+)+", re.IGNORECASE
)
_HEXADECIMAL = re.compile("[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*")
_CACHED_WORDS = 100_000
_CACHED_BYTES = 48
_SLICE_BYTES = 2 << 20
_BATCH_TOKENS = 1 << 20


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses. An address can only begin with the run of characters before its @."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            free = domain.end()
            found.append((begin, free))
        at = text.find("@", max(at + 1, free))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def pattern_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind that the patterns find, in code points, end exclusive."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if "@" in text:
        spans["email"] = _emails(text)
    if not _DIGIT.search(text):
        return spans
    spans["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans["card"].append(match.span())
    if "+" in text:
        spans["phone"] = [
            m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15
        ]
    return spans


def shape(word: bytes) -> str:
    """Letters become a, digits 9 (runs of up to five keep their length), the rest stays.

    Runs of letters collapse, punctuation at both ends is left off.
    """
    core = word.strip(_EDGES)
    if not core.translate(None, _LETTERS):
        return "a" if core else "."
    text = re.sub("[A-Za-z\ufffd]+", "a", core.decode("ascii", "replace"))
    return re.sub("[0-9]+", lambda run: "9" * min(len(run[0]), 5), text)


def coarse_shape(word: bytes) -> str | None:
    """What a word is like if its shape is not known; None if nothing can be said.

    An address with its signs spelled out, a hexadecimal address, or the number of digits and of
    groups of digits, with the brackets at the ends.
    """
    text = word.strip(_EDGES).decode("ascii", "replace")
    if _SPELLED.fullmatch(text):
        return "~at"
    if _HEXADECIMAL.fullmatch(text) and (text.count(":") > 5 or "::" in text):
        return "~h:h"
    if "[.]" in text and not text.strip("0123456789.[]"):
        return "~9[.]9"
    if re.search("[A-Za-z\ufffd]", text):
        return None
    groups = re.findall("[0-9]+", text)
    if not groups:
        return None
    ends = ("(" if text[0] == "(" else "") + (")" if text[-1] == ")" else "")
    return f"~{min(sum(map(len, groups)), 20)}/{min(len(groups), 6)}{ends}"


@dataclass(frozen=True)
class Field:
    """Weights by the kind of a word, of the one before and of the one after; and of steps."""

    kinds: dict[str, int]  # cue words and shapes that were in the table
    here: np.ndarray  # (kinds, labels)
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray  # (labels, labels)
    start: np.ndarray

    def kind(self, word: bytes, *, coarse: bool = False) -> int:
        """Number of the cue, the shape or the coarse shape (only that if ``coarse``); else 0 for
        plain letters, 1 for other words with a digit, 2 for the rest."""
        core = word.strip(_EDGES)
        cue = self.kinds.get(_cue(core))
        if cue is not None:
            return cue
        if not core.translate(None, _LETTERS):
            return 0
        found = None if coarse else self.kinds.get(shape(word))
        if found is None:
            found = self.kinds.get(coarse_shape(word) or "")
        if found is not None:
            return found
        return 1 if any(0x30 <= byte <= 0x39 for byte in core) else 2


def _cue(core: bytes) -> str:
    """A cue's name; spelled signs of an address are one, whatever brackets they are in."""
    word = core.lower()
    bare = word.strip(_BRACKETS)
    if bare in (b"at", b"dot") and bare != word:
        word = b"(%s)" % bare
    return "=" + word.decode("utf-8", "replace")


def parse(table: str) -> list[tuple[list[bytes], list[int]]]:
    """Words and labels of sentences with marked spans."""
    parsed = []
    for line in table.strip().splitlines():
        words, labels = [], []
        for piece in re.findall(r"\{[^}]*\}|[^{}]+", line):
            marked = piece.startswith("{")
            found = piece.strip("{}").split()
            kind = KINDS.index(found.pop(0)) if marked else None
            for place, word in enumerate(found):
                words.append(word.encode())
                labels.append(0 if kind is None else 1 + 2 * kind + (place > 0))
        parsed.append((words, labels))
    return parsed


def _allowed() -> np.ndarray:
    """A following word continues the same kind only."""
    allowed = np.zeros((LABELS, LABELS))
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        allowed[:, inside] = -1e4
        allowed[[inside - 1, inside], inside] = 0
    return allowed


def train(table: str | None = None, *, rounds: int = 400, shrink: float = 0.02) -> Field:
    """Maximum likelihood with shrinkage by Adam; the same table gives the same field.

    Without a table it learns from :func:`labelled`.
    """
    sentences = parse(labelled() if table is None else table)
    seen: dict[str, list[int]] = {}
    near: set[str] = set()
    for words, labels in sentences:
        lowered = [_cue(word.strip(_EDGES)) for word in words]
        for place, label in enumerate(labels):
            for one in (shape(words[place]), coarse_shape(words[place])):
                if one is not None:
                    seen.setdefault(one, []).append(label)
            if label and place and not labels[place - 1]:
                near.add(lowered[place - 1])
            if label and lowered[place] in ("=at", "=dot", "=(at)", "=(dot)"):
                near.add(lowered[place])
    # What was met once, outside, teaches the field about shapes that it does not know.
    shapes = sorted(one for one, labels in seen.items() if one != "a" and labels != [0])
    names = ["a", "9?", "x?", *shapes, *sorted(near)]
    field = Field(
        {name: number for number, name in enumerate(names)},
        *[np.zeros((len(names), LABELS)) for _ in range(3)],
        np.zeros((LABELS, LABELS)),
        np.zeros(LABELS),
    )
    # Every sentence is learnt from twice, the second time with the coarse shapes alone.
    views = [(*one, coarse) for coarse in (False, True) for one in sentences]
    longest = max(len(words) for words, _ in sentences)
    kinds = np.zeros((len(views), longest), dtype=np.int64)
    gold = np.zeros_like(kinds)
    mask = np.zeros(kinds.shape, dtype=bool)
    for row, (words, labels, coarse) in enumerate(views):
        kinds[row, : len(words)] = [field.kind(word, coarse=coarse) for word in words]
        gold[row, : len(words)] = labels
        mask[row, : len(words)] = True
    weights = [field.here, field.before, field.after, field.step, field.start]
    first = [np.zeros_like(one) for one in weights]
    second = [np.zeros_like(one) for one in weights]
    for number in range(1, rounds + 1):
        slopes = _slopes(weights, kinds, gold, mask)
        for one, slope, a, b in zip(weights, slopes, first, second, strict=True):
            slope += shrink * one
            a += 0.1 * (slope - a)
            b += 0.001 * (slope**2 - b)
            one -= 0.1 * (a / (1 - 0.9**number)) / (np.sqrt(b / (1 - 0.999**number)) + 1e-8)
    return field


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(values - most).sum(axis=axis))


def _slopes(weights, kinds, gold, mask) -> list[np.ndarray]:
    """Gradient of the negative log likelihood, by forward and backward sums over all sentences."""
    here, before, after, step, start = weights
    rows, longest = kinds.shape
    previous = np.pad(kinds, ((0, 0), (1, 0)))[:, :-1]
    following = np.pad(kinds, ((0, 0), (0, 1)))[:, 1:]
    has_before = mask & (np.arange(longest) > 0)
    has_after = np.pad(mask, ((0, 0), (0, 1)))[:, 1:] & mask
    scores = here[kinds] + before[previous] * has_before[..., None]
    scores = scores + after[following] * has_after[..., None]
    steps = step + _allowed()
    begin = start + _allowed()[0]
    forward = np.empty(scores.shape)
    forward[:, 0] = begin + scores[:, 0]
    for t in range(1, longest):
        moved = _logsum(forward[:, t - 1, :, None] + steps, axis=1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None], moved, forward[:, t - 1])
    backward = np.zeros(scores.shape)
    for t in range(longest - 2, -1, -1):
        ahead = steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
        backward[:, t] = np.where(mask[:, t + 1, None], _logsum(ahead, axis=2), 0)
    total = _logsum(forward[:, -1], axis=1)
    share = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
    wrong = share - np.eye(LABELS)[gold] * mask[..., None]
    slopes = [np.zeros_like(one) for one in weights]
    np.add.at(slopes[0], kinds, wrong)
    np.add.at(slopes[1], previous, wrong * has_before[..., None])
    np.add.at(slopes[2], following, wrong * has_after[..., None])
    for t in range(1, longest):
        inner = forward[:, t - 1, :, None] + steps + (scores[:, t] + backward[:, t])[:, None, :]
        pairs = np.exp(inner - total[:, None, None]) * mask[:, t, None, None]
        slopes[3] += pairs.sum(axis=0)
        np.add.at(slopes[3], (gold[mask[:, t], t - 1], gold[mask[:, t], t]), -1.0)
    slopes[4] += wrong[:, 0].sum(axis=0)
    return slopes


def viterbi(field: Field, kinds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of texts laid end to end, decoded side by side, the longest first."""
    if not len(kinds):
        return np.zeros(0, dtype=np.int8)
    starts = np.cumsum(lengths) - lengths
    scores = field.here[kinds]
    inner = np.ones(len(kinds), dtype=bool)
    inner[starts[lengths > 0]] = False  # has a word before it
    scores[1:] += field.before[kinds[:-1]] * inner[1:, None]
    scores[:-1] += field.after[kinds[1:]] * inner[1:, None]
    steps = field.step + _allowed()
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    came = np.zeros((len(kinds), LABELS), dtype=np.int8)
    labels = np.zeros(len(kinds), dtype=np.int8)
    best = field.start + _allowed()[0] + scores[starts[: active[0]]]
    finished = np.empty((len(order), LABELS))
    for t in range(1, longest + 1):
        n = active[t] if t < longest else 0
        finished[n : len(best)] = best[n:]
        if n:
            at = starts[:n] + t
            moved = best[:n, :, None] + steps
            came[at] = moved.argmax(axis=1)
            best = moved.max(axis=1) + scores[at]
    now = np.zeros(len(order), dtype=np.int8)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        after = active[t + 1] if t + 1 < longest else 0
        now[after:n] = finished[after:n].argmax(axis=1)
        at = starts[:n] + t
        labels[at] = now[:n]
        now[:n] = came[at, now[:n]]
    return labels


def possible(kind: str, text: str) -> bool:
    """Whether the text of a span has what its kind cannot do without."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        at = re.search(r"@|(?<![^\W_])at(?![^\W_])", text, re.IGNORECASE)
        return bool(at and re.search(r"(?<![^\W_])dot(?![^\W_])|[^.]\.[^.]", text, re.IGNORECASE))
    if kind == "ip":
        try:
            ipaddress.ip_address(text.replace("[.]", ".").strip("[]()").partition("/")[0])
        except ValueError:
            return False
        return True
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return 7 <= len(digits) <= 15


def field_spans(
    text: str, labels: np.ndarray, taken: dict[str, list[tuple[int, int]]]
) -> dict[str, list[tuple[int, int]]]:
    """Spans of labelled words without punctuation at the ends, none touching a taken span."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    wanted = np.flatnonzero(labels)
    places = {}
    for number, match in enumerate(_WORDS.finditer(text)):
        if number > wanted[-1]:
            break
        if labels[number]:
            places[number] = match.span()
    busy = [span for found in taken.values() for span in found]
    run: list[int] = []
    for number in [*wanted, -1]:
        goes_on = run and number == run[-1] + 1 and labels[number] % 2 == 0
        if run and not goes_on:
            begin, end = places[run[0]][0], places[run[-1]][1]
            body = text[begin:end]
            begin += len(body) - len(body.lstrip(".,;:!?\"'"))
            end -= len(body) - len(body.rstrip(".,;:!?\"'"))
            kind = KINDS[(labels[run[0]] - 1) // 2]
            free = begin < end and all(end <= a or b <= begin for a, b in busy)
            if free and possible(kind, text[begin:end]):
                spans[kind].append((begin, end))
            run = []
        if number >= 0:
            run.append(int(number))
    return spans


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(
        f"{kind}:{begin}:{end}" for kind in KINDS for begin, end in sorted(spans[kind])
    )


_FOUND = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "spans string, n_added bigint"
)


def _find(sent) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = sent.value
        known: dict[bytes, int] = {}
        get = known.get
        for batch in batches:
            size = max(1, batch.num_rows * _SLICE_BYTES // max(batch.nbytes, 1))
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                texts = part.column(1).to_pylist()
                kinds: list[int] = []
                lengths = []
                for text in texts:
                    words = text.encode().split()
                    numbers = list(map(get, words))
                    if None in numbers:
                        for i, number in enumerate(numbers):
                            if number is None:
                                word = words[i]
                                numbers[i] = field.kind(word)
                                if len(known) < _CACHED_WORDS and len(word) <= _CACHED_BYTES:
                                    known[word] = numbers[i]
                    kinds += numbers
                    lengths.append(len(numbers))
                lengths = np.array(lengths, dtype=np.int64)
                labels = viterbi(field, np.array(kinds, dtype=np.int64), lengths)
                ends = np.cumsum(lengths)
                found = []
                for row, text in enumerate(texts):
                    base = pattern_spans(text)
                    own = labels[ends[row] - lengths[row] : ends[row]]
                    added = field_spans(text, own, base) if own.any() else None
                    text_of_base = written(base)
                    both = text_of_base
                    if added and any(added.values()):
                        both = written({kind: base[kind] + added[kind] for kind in KINDS})
                    found.append(
                        (
                            *[len(base[kind]) for kind in KINDS],
                            hashlib.sha256(text_of_base.encode()).hexdigest(),
                            both,
                            sum(map(len, added.values())) if added else 0,
                        )
                    )
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *[pa.array(columns[i], pa.int64()) for i in range(4)],
                        pa.array(columns[4], pa.string()),
                        pa.array(columns[5], pa.string()),
                        pa.array(columns[6], pa.int64()),
                    ],
                    names=[
                        "doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans", "n_added"
                    ],
                )

    return run


def find(
    documents: DataFrame,
    *,
    field: Field | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_email, n_ip, n_card, n_phone (spans of the patterns),
    base_sha256 (of those spans), spans (all, as kind:start:end) and n_added (by the field).

    Whole texts are searched; a null text is empty and has no spans. Null ids, repeated rows and other
    columns do not matter; an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(train() if field is None else field)
    texts = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_find(sent), f"doc_id {kind}, {_FOUND}")
