"""Secret scans: fixed base patterns, and literals that are given to names which ask for secrets.

Lines with an assignment sign are lexed as source or configuration text: names,
quoted or bare literals, assignment signs, brackets and ``+``. That gives pairs of
a name and an expression, which goes on inside brackets and over line ends until
it closes; all of its literals count. In a chain of signs, as in
``api_key: str = "..."``, each name is a target. Constants are followed through the text: a name that was given
a literal stands for it where it is given on to another name, so
``K = "x9..."; api_key = K`` marks the literal of ``K``. A literal is scored by
the sensitive words of its target names and by how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_batches, text_of

# The base patterns and the least lengths of their matches.
BASE = (
    ("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}"), 0, 32),
)
KINDS = {"assign": 0, "access": 1, "hex": 2, "literal": 3}

#: Parts of names that ask for a secret, with the weight each gives.
SENSITIVE = {
    "password": 2, "passwd": 2, "passphrase": 2, "pwd": 2, "secret": 2, "apikey": 2, "privatekey": 2, "token": 1.5, "credential": 1.5,
    "credentials": 1.5, "accesskey": 2, "secretkey": 2, "authkey": 2, "signingkey": 2, "encryptionkey": 2, "auth": 1, "bearer": 1.5, "pass": 1, "key": 0.5, "salt": 0.5,
}
#: Words of texts that stand where a secret belongs but are none.
PLACEHOLDER = re.compile(r"(?ai)example|sample|dummy|changeme|placeholder|your[_-]|redacted|undefined|<.*>|\$\{|\{\{|^(?:none|null|true|false)$|^(.)\1*$|xxxx|\*\*\*")

_SIGNS = re.compile(r"[:=]")
_CONSTANT = re.compile(r"[A-Z]+(?:_[A-Z]+)+")  # as an argument, the name of a setting
_QUOTED = {'"': r'"(?:[^"\\]|\\.)*+"', "'": r"'(?:[^'\\]|\\.)*+'", "`": r"`[^`]*+`"}


def _lexer(open_: str) -> re.Pattern:
    """Of a line, or the rest of one in which some kinds of quotes aren't closed."""
    return re.compile(
        rf"""(?P<blank>[ \t\r]+|//.*|&'[a-z_]+\b(?!')|(?<![\w])\#(?!\w{{3,8}}\b).*)
        |(?P<string>{"|".join(p for q, p in _QUOTED.items() if q not in open_)})
        |(?P<sign>=>|:=|:(?!:)|=(?!=))
        |(?P<name>[^\W\d][\w.-]*+)
        |(?P<bare>(?!\+(?:[\s"'`]|$))[\w+/=.~-]++)
        |(?P<other>.)""",
        re.VERBOSE,
    )


_LEXERS = {frozenset(q): _lexer(q) for q in ("", '"', "'", "\"'")}
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_score(name: str) -> float:
    """The greatest weight of a part, or of two neighbouring parts, of a name."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0) for p in parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]), default=0)


def literal_score(value: str) -> float:
    """0 to 2: how random a literal looks, from its length, the bits of its characters and their kinds."""
    n = len(value)
    if n < 8 or any(c.isspace() for c in value) or PLACEHOLDER.search(value):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, bits / 3.5) * 0.8 + 0.3 * min(kinds, 3) + 0.3 * (n >= 20) - 0.6 * (kinds == 1)


class _Given:
    """A target and what is given to it: groups of terms (is_name, value, start, end, inner), a group for each sum, and assignments inside."""

    def __init__(self, target: str, sign: str, depth: int, indent: int, outer: _Given | None):
        self.target, self.depth, self.indent, self.outer = target, depth, indent, outer
        self.groups: list[list[tuple]] = []
        self.inside: list[_Given] = []
        if outer:
            outer.inside.append(self)
            outer.waits = False if depth > outer.depth else outer.waits
        self.waits, self.is_type, self.angles, self.paragraph = True, sign == ":", 0, None


def pairs(text: str) -> list[tuple[float, list[tuple[str, int, int]]]]:
    """Literals given to names, with positions, constants followed: each sum of literals with the greatest score of its targets."""
    given: list[_Given] = []
    done = 0
    for sign in _SIGNS.finditer(text):
        if sign.start() >= done:
            done = _read(text, text.rfind("\n", done, sign.start()) + 1 or done, given)
    weight: dict[int, float] = {}
    for g in given:  # outer ones come first
        weight[id(g)] = max(name_score(g.target), weight[id(g.outer)] if g.outer else 0)
    number = {id(g): i for i, g in enumerate(given)}
    own, stands_for = _resolved(given, number)
    out = []
    seen, seen_inside = [False] * len(given), [False] * len(given)
    for first in sorted(range(len(given)), key=lambda i: -weight[id(given[i])]):  # what is reached, is reached by its greatest weight
        w = weight[id(given[first])]
        todo = [(first, False)] if w else []
        while todo:
            i, inside = todo.pop()
            if inside and not seen_inside[i]:
                seen_inside[i] = True
                todo += [(number[id(g)], True) for g in given[i].inside]
            if not seen[i]:
                seen[i] = True
                out += [(w, _terms(group)) for group in own[i]]
                todo += [(j, True) for j in stands_for[i]]
    return out


def _terms(group: list) -> list[tuple[str, int, int]]:
    """The literals of a sum (value, start, end), those of its parts in their places, each once."""
    terms, todo, met = {}, list(reversed(group)), set()
    while todo:
        t = todo.pop()
        if isinstance(t, list):
            if id(t) not in met:
                met.add(id(t))
                todo += reversed(t)
        else:
            terms[t[1], t[2]] = t[0]
    return [(v, a, e) for (a, e), v in terms.items()]


def _tokens(text: str, start: int, stop: int) -> Iterator[re.Match]:
    """The tokens of a line. A quote that nothing closes leaves all later ones of its kind unclosed, so they aren't tried again."""
    open_, more = frozenset(), True
    while more:
        more = False
        for m in _LEXERS[open_].finditer(text, start, stop):
            yield m
            if m.lastgroup == "other" and m.group() in "\"'" and m.group() not in open_:
                open_, start, more = open_ | {m.group()}, m.end(), True
                break


def _read(text: str, start: int, out: list[_Given]) -> int:
    """Read lines from ``start`` on until no expression is open, and return the end of the last."""
    stack: list[_Given] = []
    brackets: list[tuple[str, bool, int]] = []  # whether it holds arguments or a key, which aren't values themselves, and how many so far do
    count = Counter()
    ready = plus = False

    def close(depth: int) -> None:
        while stack and stack[-1].depth >= depth:
            stack.pop()

    def add(is_name: bool, value: str, at: int, end: int) -> None:
        g = stack[-1]
        inner = is_name and len(brackets) > g.depth and brackets[-1][2] > (brackets[g.depth - 1][2] if g.depth else 0)
        if plus and g.groups:
            g.groups[-1].append((is_name, value, at, end, inner))
        else:
            g.groups.append([(is_name, value, at, end, inner)])
        g.waits = False

    while True:
        stop = text.find("\n", start)
        stop = len(text) if stop < 0 else stop
        tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _tokens(text, start, stop) if m.lastgroup != "blank"]
        indent = tokens[0][2] - start if tokens else 0
        carried = stack[-1] if stack and stack[-1].waits else None
        if not tokens:  # ends what waits for a value, and the paragraph
            if not brackets:
                close(0)
            for g in reversed(stack):
                if g.paragraph:
                    break
                g.paragraph = len(g.groups), len(g.inside)
        for k, (kind, value, at, end) in enumerate(tokens):
            depth, before = len(brackets), tokens[k - 1] if k else None
            here = stack[-1] if stack and stack[-1].depth == depth else None
            choice = k > 1 and tokens[k - 2][1] == "?" and bool(stack)  # the colon of a ? b : c
            names = k + 1 < len(tokens) and tokens[k + 1][0] == "sign" and not (before and before[1] == "?" and stack)
            if kind == "sign":
                typed = here is not None and value in ("=", ":=") and here.is_type
                if choice:
                    ready, plus = True, False
                elif before and before[0] in ("name", "string"):
                    chained = here is not None and here.waits and (here is not carried or indent > here.indent)
                    if typed:
                        here.groups.clear()
                    elif not chained:
                        close(depth)
                    stack.append(_Given(before[1].strip("\"'`"), value, depth, indent, stack[-1] if stack else None))
                    out.append(stack[-1])
                    ready, plus = True, False
                elif typed:
                    here.groups.clear()
                    here.waits, here.is_type, ready, plus = True, False, True, False
            elif kind in ("string", "name", "bare") and names:
                if here and before and before[0] in ("name", "string", "bare"):
                    here.is_type = False
            elif kind == "string" and stack:
                stack[-1].is_type = stack[-1].is_type and depth > stack[-1].depth
                key = brackets and brackets[-1][:2] == ("[", True)
                if not key and not (brackets and brackets[-1][1] and _CONSTANT.fullmatch(value[1:-1])):
                    add(False, value[1:-1], at + 1, end - 1)
                ready = plus = False
            elif kind in ("name", "bare") and stack:
                if here and before and before[0] in ("name", "bare"):
                    here.is_type = False
                alone = len(tokens) == 1 or (len(tokens) == 2 and tokens[1][1] in ",;\\")
                prose = carried is not None and carried is here and not plus and not (alone and (indent > here.indent or any(c.isdigit() for c in value)))
                if ready and not (prose and k == 0 and not brackets):
                    add(True, value, at, end)
                elif ready:
                    close(depth)
                ready = plus = kind == "name" and value == "or"
                plus = False
            elif value in "([{" and stack:
                inner = value == "(" or value == "[" and before is not None and before[3] == at and (before[0] == "name" or before[1] in (")", "]"))
                brackets.append((value, inner, inner + (brackets[-1][2] if brackets else 0)))
                count[value] += 1
                ready, plus = True, False
            elif value in ")]}" and not brackets:  # of a bracket around the whole assignment
                close(0)
            elif value in ")]}":
                opened = "([{"[")]}".index(value)]
                if count[opened]:
                    while (last := brackets.pop()[0]) != opened:
                        count[last] -= 1
                    count[opened] -= 1
                    close(len(brackets) + 1)
                    ready = False
            elif value == "+":
                ready = plus = True
            elif value in "<>" and here:
                here.angles += 1 if value == "<" else -1
            elif value in "|?" and stack:
                ready, plus = True, False
            elif value in ",;" and not (value == "," and here and here.is_type and here.angles > 0):
                close(depth if depth else 0)
                ready, plus = bool(stack), False
        follows = bool(tokens) and (plus or tokens[-1][1] == "\\" or (stack and stack[-1].waits) or text[stop : stop + 200].lstrip().startswith("+"))
        if not brackets and not follows:
            close(0)
        if stop == len(text):
            for g in stack if brackets else ():  # brackets that nothing closes hold their paragraph
                if g.paragraph:
                    for later in g.inside[g.paragraph[1] :]:
                        later.outer = None
                    del g.groups[g.paragraph[0] :], g.inside[g.paragraph[1] :]
        if stop == len(text) or not stack:
            return stop
        start = stop + 1


def _resolved(given: list[_Given], number: dict[int, int]) -> tuple[list[list[list]], list[list[int]]]:
    """Of each assignment its own groups, and those it stands for with all they hold, as names were last assigned before (or first behind).

    A group is a list of literals (value, start, end) and of groups that names in a sum
    stand for. A name for one group is a part of the sum, one for several is all of them.
    """
    places: dict[str, list[int]] = {}
    for i, g in enumerate(given):
        if g.groups or g.inside:
            places.setdefault(g.target, []).append(i)

    def source(name: str, i: int) -> int | None:
        at = places.get(name)
        if at is None:
            return None
        k = bisect_left(at, i)
        j = at[k - 1] if k else next((x for x in at[:2] if x != i), None)
        return j

    own: list[list | None] = [None] * len(given)
    stands_for: list[list[int]] = [[] for _ in given]
    whole: list[list] = [[] for _ in given]  # up to two groups given to each so far, those of assignments inside too

    begun: set[int] = set()
    left = [len(g.inside) for g in given]  # assignments inside that may not have begun, counted from the first
    for first in range(len(given)):
        todo = [first]
        while todo:  # what a name stands for is resolved before it; circles end
            i = todo[-1]
            if i < 0:  # those inside of another, the last first
                inside = given[~i].inside
                while left[~i] and number[id(inside[left[~i] - 1])] in begun:
                    left[~i] -= 1
                if left[~i]:
                    todo.append(number[id(inside[left[~i] - 1])])
                else:
                    todo.pop()
                continue
            if own[i] is None and i not in begun:
                begun.add(i)
                needed = {j for group in given[i].groups for t in group if t[0] and (j := source(t[1], i)) is not None}
                for j in needed:
                    todo += [j, ~j] if j not in begun else [~j]
                continue
            todo.pop()
            if own[i] is not None:
                continue
            groups, names = [], []
            for group in given[i].groups:
                joined: list = []
                for is_name, value, at, end, inner in group:
                    j = source(value, i) if is_name else None
                    if j is None:
                        if not inner:
                            joined.append((value, at, end))
                        continue
                    known = whole[j]
                    if len(known) == 1:
                        joined.append(known[0])
                    elif known:
                        stands_for[i].append(j)
                        names += known
                if joined:
                    groups.append(joined[0] if len(joined) == 1 and isinstance(joined[0], list) else joined)
            own[i] = groups
            more, k = groups + names, i
            while more and k is not None:  # what is inside of others counts for them
                more = _added(whole[k], more)
                k = number[id(given[k].outer)] if given[k].outer else None
    return [o or [] for o in own], stands_for


def _added(held: list, groups: list) -> list:
    """Add what is new of ``groups`` to a list of two at most, and return that."""
    same = lambda a, b: a is b or (len(a) == len(b) and all(x is y or (isinstance(x, tuple) and x == y) for x, y in zip(a, b, strict=True)))
    new = []
    for g in groups:
        if len(held) == 2:
            break
        if not any(same(g, h) for h in held):
            held.append(g)
            new.append(g)
    return new


def found(text: str, threshold: float = 2.2) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, base ones as the patterns give them and the method's literals besides."""
    spans = [(m.start(), m.end(), kind) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if len(m.group(group)) >= least]
    if "=" in text or ":" in text:
        literal = {}
        for weight, terms in pairs(text):
            score = literal_score("".join(t[0] for t in terms))
            if score > 0 and weight + score >= threshold:
                literal |= {(at, end): None for _, at, end in terms if end > at}
        spans += [(at, end, "literal") for at, end in literal]
    return sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1]))


def scan(docs: DataFrame, threshold: float = 2.2) -> DataFrame:
    """Of every whole text: doc_id, counts and digest of the base spans, and all spans.

    Spans are ``kind:start:end`` in code points, joined by commas. A null text is
    empty; repeated rows and null ids stay; other columns aren't read.
    """

    def make():
        def batch(keys, texts):
            for key, text in zip(keys, texts, strict=True):
                spans = found(text, threshold)
                shown = [f"{kind}:{at}:{end}" for at, end, kind in spans]
                base = ",".join(s for s, (_, _, kind) in zip(shown, spans, strict=True) if kind != "literal")
                n = Counter(kind for _, _, kind in spans)
                yield key, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(shown)

        return batch

    return map_batches(docs.select("doc_id", text_of(docs).alias("text")), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
