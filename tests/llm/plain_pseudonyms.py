"""Pseudonyms one text at a time in plain Python, to compare the operator with. The patterns are the operator's own."""

import datetime
import hashlib

import regex

from ravelin.llm import pseudonyms as P

FIRST = datetime.date(1800, 1, 1)


def ascii_only(pattern):
    """The pattern with digits and word characters of ASCII alone, other classes as they are."""
    out, inside = "", False
    for part in regex.findall(r"\\.|[^\\]", pattern):
        inside = part != "]" and (inside or part == "[")
        for short, long in ((r"\d", "0-9"), (r"\w", "A-Za-z0-9_")):
            part = part if part != short else long if inside else f"[{long}]"
        out += part
    return out


def feistel(left, right, a, b, key, kind):
    for k in range(1, 9):
        told = lambda x, k=k: int(hashlib.sha256("|".join(map(str, (key, kind, a, b, k, x))).encode()).hexdigest()[:15], 16)
        if k % 2 == 0:
            left = (left + told(right) % a) % a
        else:
            right = (right + told(left) % b) % b
    return left, right


def digits_of(value):
    return "".join(c for c in value if c in "0123456789")


def permuted(d, key, kind):
    half = len(d) // 2
    left, right = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), key, kind)
    return str(left).rjust(half, "0") + str(right).rjust(len(d) - half, "0")


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10


def in_shape(value, d):
    left = iter(d)
    return "".join(next(left) if c in "0123456789" else c for c in value)


def read_date(value):
    if "-" in value:
        y, m, d = map(int, value.split("-"))
        tries = [(y, m, d)]
    else:
        a, b, y = map(int, regex.split("[./]", value))
        tries = [(y, b, a), (y, a, b)]
    for t in tries:
        try:
            day = datetime.date(*t)
        except ValueError:
            continue
        return day if 1800 <= day.year < 2200 else None
    return None


def date(value, key):
    at = (read_date(value) - FIRST).days
    left, right = feistel(at // 773, at % 773, 189, 773, key, "date")
    new = FIRST + datetime.timedelta(days=left * 773 + right)
    if "-" in value:
        return new.isoformat()
    mark = "." if "." in value else "/"
    one, two, _ = value.split(mark)
    form = "{}" if min(len(one), len(two)) == 1 else "{:02d}"
    order = (new.month, new.day) if int(two) > 12 else (new.day, new.month)
    return mark.join([*(form.format(x) for x in order), str(new.year)])


def kind_of(value):
    whole = lambda p: regex.fullmatch(ascii_only(p), value)
    d = digits_of(value)
    if "@" in value:
        return "email"
    if whole(P.SECRET):
        return "secret"
    if whole(P.DATE):
        return "date" if read_date(value) else None
    if whole(P.ADDRESS):
        return "address" if all(int(x) < 256 for x in value.split(".")) else None
    if whole(P.SOCIAL):
        area, group, serial = value.split("-")
        return "social" if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else None
    return "phone" if 7 <= len(d) <= 15 else None


def hidden(value, key, kind, least=0):
    digest = hashlib.sha512("|".join((key, kind, value)).encode()).hexdigest()
    n = max(len(value), least)
    return (digest * (n // 128 + 1))[:n]


def email_name(name, key):
    own = "".join(c for c in name if c in P.LETTERS)
    if not 1 <= len(own) <= 16 or len(name) > 64 or set(name) - set(P.LETTERS + "._%+-"):
        return hidden(name, key, "email", 12)
    half = len(own) // 2
    number = lambda x: sum(P.LETTERS.index(c) * 62**k for k, c in enumerate(reversed(x)))
    text = lambda x, n: "".join(P.LETTERS[x // 62**k % 62] for k in reversed(range(n)))
    left, right = feistel(number(own[:half]), number(own[half:]), 62**half, 62 ** (len(own) - half), key, "email")
    new = iter(text(left, half) + text(right, len(own) - half))
    return "".join(next(new) if c in P.LETTERS else c for c in name)


def pseudonym(value, kind, key):
    d = digits_of(value)
    if kind == "email":
        name, host = value.split("@", 1)
        return email_name(name, key) + "@" + host
    if kind == "secret":
        new = hidden(value, key, "secret")
        return new.upper() if regex.search("[A-F]", value) else new
    if kind == "date":
        return date(value, key)
    if kind == "address":
        a, b, c, e = map(int, value.split("."))
        left, right = feistel(a * 256 + b, c * 256 + e, 65536, 65536, key, "address")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "social":
        area = int(d[:3]) - (1 if int(d[:3]) < 666 else 2)
        left, right = feistel(area * 99 + int(d[3:5]) - 1, int(d[5:]) - 1, 898 * 99, 9999, key, "social")
        area = left // 99 + (1 if left // 99 < 665 else 2)
        return f"{area:03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if kind == "card":
        body = permuted(d[:-1], key, "card")
        return in_shape(value, body + str(-luhn(body + "0") % 10))
    if kind == "phone":
        code = regex.match(rf"(?:{P.CODES}|\d{{3}})", d).group() if value.startswith("+") else ""
        return in_shape(value, code + permuted(d[len(code) :], key, "phone"))
    return value


def cards_in(run):
    """(is a card, piece) of a run of digits."""
    groups, at, whole, out = regex.findall(r"[ -]?[0-9]+", run), 0, 0, []
    while at < len(groups):
        tail, first = "".join(groups[at : at + 20]), groups[at][: len(groups[at]) - len(groups[at].lstrip(" -"))]
        tail = tail[len(first) :]
        tries = []
        if at >= whole and (m := regex.match(ascii_only(P.CARD), tail)):
            tries.append(m.group())
            whole = at + len(regex.findall("[ -]", m.group())) + 1
        tries += [m.group() for g in P.GROUPED if (m := regex.match(ascii_only(rf"{g}(?!\d)"), tail))]
        card = next((t for t in tries if luhn(digits_of(t)) == 0 and set(digits_of(t)) != {"0"}), None)
        if card:
            out += [(False, first), (True, card)]
            at += len(regex.findall("[ -]", card)) + 1
        else:
            out.append((False, groups[at]))
            at += 1
    return out


def replaced(text, key):
    """The new text and the finds (kind, value, pseudonym)."""
    finds = []

    def one(m):
        value = m.group()
        run = regex.fullmatch("[0-9](?:[ -]?[0-9]){12,}", value) and not regex.fullmatch(ascii_only(P.SECRET), value)
        pieces = [("card" if card else None, x) for card, x in cards_in(value)] if run else [(kind_of(value), value)]
        new = [(kind, x, pseudonym(x, kind, key)) for kind, x in pieces]
        finds.extend(x for x in new if x[0])
        return "".join(x[2] for x in new)

    return regex.sub(ascii_only(P.FINDS), one, text), finds
