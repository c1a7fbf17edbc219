"""A small labelled sample of loose personal data and of what resembles it.

Sentences are filled with seeded numbers and names, so the sample is the same in every run.
The kind is that of the loose span in the sentence, None where it holds no personal data.
The sentences are dealt into parts without a common one: the trees are fitted on the first,
their thresholds calibrated on the second, and a test measures them on the third. In each,
personal data stands with and without a cue, and so does what is none.
"""

from __future__ import annotations

import random

#: Fills of each sentence.
FILLS = 40
FIT, CALIBRATE, TEST = "fit", "calibrate", "test"
SENTENCES: dict[str, list[tuple[str | None, str]]] = {
    FIT: [
        ("email", "write to {name} (at) {host} (dot) com please"),
        ("email", "{name}.{name} [at] {host} [dot] org"),
        ("email", "ask {name}[at]{host}[dot]{host}[dot]de for more"),
        ("email", "contact {name} (at) {host}.com today"),
        ("email", "signed, {name} ({name}(at){host}(dot)net)"),
        (None, "it was priced (at) {d}{d}.{d}{d} each"),
        (None, "they met (at) noon.then left"),
        (None, "contact was made (at) {d}{d}.{d}{d} hours"),
        (None, "the mail came (at) {n}.{d}{d} sharp"),
        ("phone", "please call ({0}{d}{d}) {n}{d}{d} {d}{d}{d}{d} now"),
        ("phone", "the office is ({n}{d}{d}) {n}{d}{d}-{d}{d}{d}{d} all day"),
        ("phone", "tel. 0{n}{d}-{n}{d}{d}-{d}{d}{d}{d}"),
        ("phone", "Tel.: 0{n}{d}{d}/{n}{d}{d}{d}{d}{d}{d}"),
        ("phone", "my mobile: {n}{d}{d}-{n}{d}{d}-{d}{d}{d}{d}."),
        ("phone", "you can reach us under 1-{n}{d}{d}-{n}{d}{d}-{d}{d}{d}{d} at any time"),
        ("phone", "fax (0{n}{d}{d}) {n}{d}{d}{d} {d}{d}"),
        ("phone", "{name}, 0{n}{d}{d} {n}{d}{d}{d}{d}{d}{d}, will help"),
        (None, "telephone sales rose {year} {year} {year}"),
        (None, "call {n}{d}{d}{d}{d}{d}{d}{d} units in stock"),
        (None, "the phone {year}-{year} and later"),
        (None, "phone model {n}{d}{d}{d}-{d}{d}{d}{d}-{d} sold out"),
        (None, "calls rose from {n}{d}{d} {d}{d}{d} to {n}{d}{d} {d}{d}{d}"),
        (None, "upgrade to version {n}{d}.{d}.{d}{d}{d}.{d}{d}{d}{d} soon"),
        (None, "order part {d}{d}-{d}{d}{d}{d}-{d}{d}{d} again"),
        (None, "spare no. {n}{d}{d}-{d}{d}-{d}{d}{d}{d} is gone"),
        (None, "isbn 978-{d}-{d}{d}-{d}{d}{d}{d}{d}{d}-{d} in print"),
        (None, "dated {year}-0{n}-1{d} 1{d} in the log"),
        (None, "rows {n}{d}{d} {n}{d}{d} {n}{d}{d} {n}{d}{d} follow"),
        (None, "telecom index {n}{d}{d}.{n}{d}.{n}{d}.{n}{d}.{n}{d} fell"),
        (None, "id {n}{d}{d}{d}{d}{d}{d}{d}{d}{d} of the caller list"),
        (None, "in {year} {year} {year} and {year}"),
        ("card", "pay with card {card} until then"),
        ("card", "visa {card}, valid"),
        ("card", "the number {card} was used"),
        ("card", "{name}: {card}"),
        (None, "serial {n}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{z} on the back"),
        (None, "card batch {n}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{z} printed"),
        (None, "build {n}.{d}{d}.{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{d}{d} failed"),
        (None, "order {n}{d}{d}{d}-{d}{d}{d}{d}-{d}{d}{d}{d}-{d}{d}{d}{d} shipped"),
    ],
    CALIBRATE: [
        ("email", "my mail is {name}(at){host}(dot)net and"),
        ("email", "send it to {name}.{host} [at] {host} [dot] com by noon"),
        ("email", "by {name} (at) {host}.org, editor"),
        (None, "we stayed (at) {host}.next day"),
        (None, "write-ups start (at) {n}{d}.{d}{d} and"),
        (None, "the rate stood (at) {d}.{d}{d}{d} percent"),
        ("phone", "phone 0{n}{d}{d} {n}{d}{d}{d}{d}{d}{d}, ask"),
        ("phone", "contact sales at 1-{n}{d}{d}-{n}{d}{d}-{d}{d}{d}{d} today"),
        ("phone", "the clinic (({n}{d}{d}) {n}{d}{d}-{d}{d}{d}{d}) is open"),
        ("phone", "call 0{n}{d}/{n}{d}{d}{d}{d}{d}{d} after six"),
        ("phone", "or ask {name} on (0{n}{d}{d}) {n}{d}{d} {d}{d}{d}{d}"),
        (None, "telephone lines grew {year} {year}"),
        (None, "call number {n}{d}{d}{d}{d}{d}{d} of the shelf"),
        (None, "mobile plan {year}-{year} for all"),
        (None, "release {n}.{d}{d}.{d}{d}.{d}{d}{d} is out"),
        (None, "part {n}{d}{d}{d}-{d}{d}{d}{d}-{d}{d} fits"),
        (None, "invoice {n}{d}{d}{d}{d}{d}{d}{d} was sent"),
        (None, "fax paper {n}{d}{d} {n}{d}{d} {n}{d}{d} sheets"),
        (None, "isbn 979-{d}{d}-{d}{d}{d}-{d}{d}{d}{d}-{d} by phone order"),
        (None, "on {year}-1{n}-0{n} 0{d} the call ended"),
        ("card", "credit card no. {card} please"),
        ("card", "take {card} instead"),
        (None, "visa form {n}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{z} filed"),
        (None, "paid {n}.{d}{d}.{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{d}{d} in all"),
    ],
    TEST: [
        ("email", "questions go to {name} (at) {host} (dot) org"),
        ("email", "reply [{name}[at]{host}[dot]com] soon"),
        (None, "mail arrives (at) {n}.{d}{d} each day"),
        (None, "the choir sang (at) {host}.we clapped"),
        ("phone", "our desk: (0{n}{d}{d}) {n}{d}{d} {d}{d}{d}{d}, weekdays"),
        ("phone", "phone me at {n}{d}{d}-{n}{d}{d}-{d}{d}{d}{d} tonight"),
        ("phone", "Telefon 0{n}{d}{d}/{n}{d}{d}{d}{d}{d}{d} oder"),
        (None, "phone books of {year} {year} {year} remain"),
        (None, "mobile phones {year}-{year} compared"),
        (None, "call {n}{d}{d}{d}{d}{d}{d}{d} shares were sold"),
        (None, "stock {n}{d}{d}{d}-{d}{d}{d}{d}-{d} by telephone"),
        (None, "software {n}{d}.{d}.{d}{d}{d}.{d}{d}{d}{d} calls home"),
        (None, "see isbn 978-{d}-{d}{d}-{d}{d}{d}{d}{d}{d}-{d}"),
        ("card", "bill it to {card} now"),
        ("card", "my visa: {card}"),
        (None, "card deck {n}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{z} sold"),
    ],
}


def luhn_digit(number: str) -> str:
    """The digit that makes ``number`` pass the Luhn check."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(number)))
    return str(-total % 10)


def _filled(sentence: str, rnd: random.Random) -> str:
    number = lambda: rnd.choice(["", str(rnd.randint(1, 9)), str(rnd.randint(10, 99)), str(rnd.randint(100, 2030))])
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(3, 9))) + number()
    year = lambda: str(rnd.randint(1890, 2035))
    fills = {"year": year, "d": lambda: str(rnd.randint(0, 9)), "n": lambda: str(rnd.randint(1, 9)), "0": lambda: "0", "name": word, "host": word}
    out, *rest = sentence.split("{")
    for piece in rest:
        name, tail = piece.split("}", 1)
        if name == "card":
            digits = "4" + "".join(str(rnd.randint(0, 9)) for _ in range(14))
            digits += luhn_digit(digits)
            value = ".".join(digits[i : i + 4] for i in range(0, 16, 4))
        elif name == "z":  # a last digit that fails the check
            digits = "".join(c for c in out if c.isdigit())
            value = str((int(luhn_digit(digits)) + rnd.randint(1, 9)) % 10)
        else:
            value = fills[name]()
        out += value + tail
    return out


def labelled(part: str) -> list[tuple[str | None, str]]:
    """(kind or None, text) of a part of the sample, without repeats, in a fixed order."""
    rnd = random.Random(f"17:{part}")
    return list(dict.fromkeys((kind, _filled(sentence, rnd)) for kind, sentence in SENTENCES[part] for _ in range(FILLS)))
