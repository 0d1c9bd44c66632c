"""One-pass scan of a text for many patterns: an automaton of literals that matches need says which patterns to run."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as syntax

#: Letters that case-insensitive patterns take for i, s and k, though their lower case is another letter.
_ALIKE = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def folded(text: str) -> str:
    """Text in which every literal of a case-insensitive pattern is found by its own ``folded`` form."""
    for letter, plain in _ALIKE.items():  # rare letters: a search for each is far cheaper than a look at every character
        text = text.replace(letter, plain)
    return text.lower()


def required(pattern: str) -> frozenset[str] | None:
    """Literals of which any match has at least one, the longest that the pattern's structure gives; None where it needs none."""
    return _needed(syntax.parse(pattern))


def _needed(parsed: list) -> frozenset[str] | None:
    options, run = [], ""

    def flush() -> None:
        nonlocal run
        if run:
            options.append(frozenset([folded(run)]))
        run = ""

    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        flush()
        inner = None
        if name == "SUBPATTERN":
            inner = _needed(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = _needed(arg[2])
        elif name == "BRANCH":
            each = [_needed(x) for x in arg[1]]
            inner = None if None in each else frozenset().union(*each)
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            inner = frozenset(folded(chr(c)) for _, c in arg)
        if inner:
            options.append(inner)
    flush()
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


@dataclass(frozen=True)
class Rule:
    """A pattern of a claim type and what of a match is the claim.

    ``kind``: ``match`` (all of it), ``context`` (all of it, and as context ``before`` and ``after`` characters around it), ``groups`` (joined by ``joint``, after
    ``label``), ``line`` (group 1 of a stripped line that matches; ``also`` must be found in it, ``given`` somewhere in the lower-cased
    text). ``distinct``: a text already found for the claim type, in any case, is left out. ``anchor`` and ``lead``: a part that every match
    has, and the characters that (but for blanks and one ``joint``) stand before it within one, so that the pattern is tried only there.
    """

    claim_type: str
    pattern: str
    kind: str = "match"
    before: int = 0
    after: int = 0
    label: str = ""
    joint: str = " "
    distinct: bool = False
    also: str = ""
    given: str = ""
    anchor: str = ""
    lead: str = ""
    least: int = 1


class Scanner:
    """Rules compiled once in a worker, with one automaton over the literals that they need."""

    def __init__(self, rules: list[Rule]) -> None:
        import ahocorasick

        self.rules = [(r, re.compile(r.pattern), re.compile(r.also) if r.also else None, re.compile(r.anchor) if r.anchor else None) for r in rules]
        self.always, by_literal = set(), {}
        for k, r in enumerate(rules):
            needs = required(r.anchor or r.pattern)
            if needs is None or min(map(len, needs)) < 2:  # single letters are in every text
                self.always.add(k)
                continue
            for literal in needs:
                by_literal.setdefault(literal, set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for literal, which in by_literal.items():
            self.automaton.add_word(literal, frozenset(which))
        if by_literal:
            self.automaton.make_automaton()
        self.empty = not by_literal

    def candidates(self, text: str) -> set[int]:
        """The rules whose literals the text has; the walk ends when all are found."""
        found = set(self.always)
        if not self.empty:
            for _, which in self.automaton.iter(folded(text)):
                found |= which
                if len(found) == len(self.rules):
                    break
        return found

    def matches(self, k: int, text: str) -> Iterator[re.Match]:
        """The rule's matches in order, as ``finditer`` gives them."""
        rule, pattern, _, anchor = self.rules[k]
        if anchor is None:
            yield from pattern.finditer(text)
            return
        done = 0
        for a in anchor.finditer(text):
            if a.start() < done:
                continue
            start = a.start()
            while start > done and text[start - 1].isspace():
                start -= 1
            start -= start > done and text[start - 1] == rule.joint
            while start > done and (text[start - 1] in rule.lead or text[start - 1].isspace()):
                start -= 1
            for at in range(start, a.start()):
                if m := pattern.match(text, at):
                    done = m.end()
                    yield m
                    break

    def claims(self, text: str) -> list[tuple[str, str, int | None, int | None, str]]:
        """``(claim_type, claim_text, start, stop, context)`` in the order of rules and places; the context is the text itself where a rule has none."""
        wanted, out, seen, lines, lower = self.candidates(text), [], set(), None, None
        for k, (rule, pattern, also, _) in enumerate(self.rules):
            if k not in wanted:
                continue
            if rule.given:
                lower = text.lower() if lower is None else lower
                if rule.given not in lower:
                    continue
            if rule.kind == "line":
                lines = [x.strip() for x in text.split("\n")] if lines is None else lines
                for line in lines:
                    m = pattern.match(line)
                    said = m.group(1).strip() if m else ""
                    if len(said) >= rule.least and (also is None or also.search(said)):
                        out.append((rule.claim_type, said, None, None, said))
                continue
            for m in self.matches(k, text):
                if rule.kind == "groups":
                    said = rule.joint.join(g or "" for g in m.groups()) if m.groups() else m.group()
                    said = f"{rule.label}: {said}" if rule.label else said.strip()
                else:
                    said = m.group().strip()
                if not said:
                    continue
                if rule.distinct:
                    if (rule.claim_type, said.lower()) in seen:
                        continue
                    seen.add((rule.claim_type, said.lower()))
                around = text[max(0, m.start() - rule.before) : m.end() + rule.after].strip() if rule.kind == "context" else said
                out.append((rule.claim_type, said, m.start(), m.end(), around))
        return out


def disjoint(found: list[tuple]) -> list[tuple]:
    """Of ``(weight, start, stop, name, text, ...)`` the heaviest first, without those that overlap a kept one or repeat its text in any case; in order of start."""
    kept, places, said = [], [], set()
    for f in sorted(found, key=lambda f: -f[0]):
        at = bisect(places, (f[1], f[2]))
        over = any(f[1] < stop and start < f[2] for start, stop in places[max(0, at - 2) : at + 2])
        if over or f[4].lower() in said:
            continue
        places.insert(at, (f[1], f[2]))
        said.add(f[4].lower())
        kept.append(f)
    return sorted(kept, key=lambda f: f[1])
