"""The sentence rules as a finite transducer over lexical symbols, and stretches of symbols as functions of its states.

A state tells whether a sentence is open, which kind of end mark is pending, and which quotation or
bracket is open. Two registers, the place of the last character of prose and that of the pending mark,
are only copied and emitted. ``transition`` states the rules; ``step`` compiles them, entry by entry, into
the table that every reading runs on.

A stretch of symbols is the function from each state before it to the state and registers behind it.
All states are run at once; those that have come to agree go on as one, so that a stretch costs little
more than one reading.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cache
from typing import NamedTuple


class State(NamedTuple):
    """pend: kind of the pending mark; near: nothing but closers since; quote: its opener, headed: it opens the sentence; bracket: 1 in, 2 before the sentence."""

    open: bool = False
    pend: str = ""
    near: bool = False
    quote: str = ""
    headed: bool = False
    bracket: int = 0
    thai: bool = False


class Step(NamedTuple):
    """state: the next one; emit: what ends a sentence (P the pending mark, L the last character, N the symbol's own place); last: it moves here; mark: the pending mark is here (1) or where last was (2)."""

    state: State
    emit: str
    last: bool
    mark: int


CLEAN = State()
CLASSES = ("low", "up", "plain", "digit", "punct", "thai", "sign", "macro")
#: Kinds of a pending mark: plain, behind an abbreviation that may end (B) or never ends (N), a number (O), full (E), dots (F),
#: behind a quoted or bracketed sentence (D), in a quotation inside a sentence (Q), a gap between Thai letters (T).
KINDS = "ABNOEFDQT"
PARA, GAP, TIE, CITE, BRACE, HERE, JOIN, WIDE, UPRIGHT, END = ((x,) for x in ("para", "gap", "tie", "cite", "brace", "here", "join", "wide", "upright", "end"))


@cache
def word(cls: str, month: bool = False, thai: bool = False, tail: bool = False) -> tuple:
    """Prose: the class of its first character, whether it begins with a month, ends in Thai, and a blank follows that."""
    return ("word", cls, month, thai, tail)


@cache
def mark(kind: str, dots: bool) -> tuple:
    """End marks: their kind from what stands around them, and whether the last is a full stop."""
    return ("mark", kind, dots)


@cache
def opener(char: str, cls: str) -> tuple:
    """An opening ( or quotation (g, „, “, or " for one that may also close) before a character of this class."""
    return ("opener", char, cls)


@cache
def closer(char: str) -> tuple:
    """A closing ) or quotation (» or q for others)."""
    return ("closer", char)


def symbols() -> list[tuple]:
    """The whole alphabet."""
    flags = (False, True)
    return [
        PARA, GAP, TIE, CITE, BRACE, HERE, JOIN, WIDE, UPRIGHT, END,
        *[word(c, m, t, g) for c in CLASSES for m in flags for t in flags for g in flags if t or not g],
        *[mark(k, d) for k in "ABNOEF" for d in flags],
        *[opener(c, x) for c in '(g„“"' for x in CLASSES],
        *[closer(c) for c in ")»q"],
    ]


def _ends(pend: str, cls: str, month: bool) -> bool:
    """Whether a pending mark of this kind ends the sentence before a token of this class."""
    if pend == "E":
        return True
    if pend in ("A", "O"):
        return cls not in ("low", "punct") and not (pend == "O" and month)
    if pend in ("B", "D"):  # scripts without case go on behind a quoted sentence
        return cls in ("up", "digit", "sign", "macro")
    if pend == "T":
        return cls == "thai"
    return pend == "F" and cls == "up"


def transition(s: State, sym: tuple) -> Step:
    """The rules. Parts of a state that cannot matter are cleared, so that equal futures are equal states."""
    new, emit, last, at = _rule(s, sym)
    if not new.pend:
        new = new._replace(near=False, thai=new.thai and new.open)
    else:
        new = new._replace(thai=False)
    return Step(new, emit, last, at)


def _rule(s: State, sym: tuple) -> tuple[State, str, bool, int]:
    what = sym[0]
    if what == "para":
        return CLEAN, "P" if s.pend and s.pend != "T" else "L" if s.open else "", False, 0
    if what == "gap":
        if s.thai and s.open and not s.pend:
            return s._replace(near=False, pend="T"), "", False, 2
        return s._replace(near=False), "", False, 0
    if what == "tie":
        return s._replace(near=False), "", False, 0
    if what == "end":  # the end of a sentence between two Thai letters of one token
        return s, "N", False, 0
    if what == "here":
        return s, "", True, 0
    if what == "wide":
        return s._replace(thai=False), "", True, 0
    if what == "join":
        return s._replace(pend="", open=True, thai=False), "", True, 0
    if what in ("cite", "brace", "upright"):
        t = s._replace(pend="") if what == "cite" and s.pend in ("B", "T") else s
        if t.open and not t.pend:
            return (t if what == "brace" else t._replace(thai=False)), "", True, 0
        return t, "", False, 0
    if what == "mark":
        return _marked(s, sym[1], sym[2])
    if what == "opener" and ((sym[1] == "“" and s.quote == "„") or (sym[1] == '"' and s.quote == '"')):
        return _closed(s, "q")
    if what == "closer":
        return _closed(s, sym[1])
    return _shown(s, sym)


def _marked(s: State, kind: str, dots: bool) -> tuple[State, str, bool, int]:
    if not s.open and not s.pend:
        return s, "", False, 0  # a mark without a sentence
    if s.pend and s.near:
        pend = "F" if dots and s.pend == "F" else "A" if s.pend in "ABNOF" else s.pend
        return s._replace(pend=pend), "", False, 1
    return s._replace(pend="Q" if s.quote and not s.headed else kind, near=True, thai=False), "", False, 1


def _closed(s: State, char: str) -> tuple[State, str, bool, int]:
    goes_on = s._replace(pend="", open=True, thai=False)
    if char == ")":
        if s.pend and s.near:
            pend = "D" if s.bracket == 1 and s.pend in "AEOBN" else s.pend
            return s._replace(pend=pend, bracket=0), "", False, 1
        return goes_on._replace(bracket=0), "", True, 0
    if s.pend and (s.near or char == "»"):
        return s._replace(pend="D", near=True, quote="", headed=False), "", False, 1
    return goes_on._replace(quote="", headed=False), "", True, 0


def _shown(s: State, sym: tuple) -> tuple[State, str, bool, int]:
    """A word, formula, macro or opener."""
    opens = sym[0] == "opener"
    cls, month, thai, tail = (sym[2], False, False, False) if opens else sym[1:]
    if opens and cls in ("punct", "plain", "thai"):
        cls = cls if s.pend == "D" and cls == "plain" else "sign"
    emit = ""
    if s.pend:
        if _ends(s.pend, cls, month):
            emit, s = "P", s._replace(open=False, quote="", headed=False, bracket=0)
        s = s._replace(pend="")
    if opens:
        c = sym[1]
        if c == "(":
            s = s._replace(bracket=1 if s.open else 2)
        elif not s.quote:
            s = s._replace(quote=c if c in '"„' else "g", headed=not s.open)
    return s._replace(open=True, near=False, thai=thai, pend="T" if tail else ""), emit, True, 1 if tail else 0


class _Table(dict):
    """symbol -> {state -> step}, compiled as entries are asked for."""

    def __missing__(self, sym: tuple) -> dict:
        row = self[sym] = _Row(sym)
        return row


class _Row(dict):
    def __init__(self, sym: tuple) -> None:
        super().__init__()
        self.sym = sym

    def __missing__(self, s: State) -> Step:
        # states are interned, so that equal ones are one object
        made = transition(s, self.sym)
        made = self[s] = made._replace(state=_INTERNED.setdefault(made.state, made.state))
        return made


_INTERNED: dict[State, State] = {CLEAN: CLEAN}
TABLE = _Table()


@cache
def states() -> tuple[State, ...]:
    """All states that some symbols lead to, the first being the clean one."""
    found, wait, alphabet = {CLEAN}, [CLEAN], symbols()
    while wait:
        s = wait.pop()
        for sym in alphabet:
            t = TABLE[sym][s].state
            if t not in found:
                found.add(t)
                wait.append(t)
    return (CLEAN, *sorted(found - {CLEAN}))


class Config(NamedTuple):
    """A state with its registers; -1 and -2 stand for last and mark as they were before the stretch."""

    state: State = CLEAN
    last: int = 0
    mark: int = 0


def read(stream: Iterable[tuple], c: Config, out: list[int] | None) -> Config:
    """Run (symbol, place) pairs from ``c``; ends of sentences are appended to ``out``."""
    s, last, pend_at = c
    table = TABLE
    for sym, pos in stream:
        s, emit, moves, at = table[sym][s]
        if emit and out is not None:
            out.append(pend_at if emit == "P" else last if emit == "L" else pos)
        if at:
            pend_at = pos if at == 1 else last
        if moves:
            last = pos
    return Config(s, last, pend_at)


def finish(c: Config) -> list[int]:
    """The end of a sentence that is open at the end of a document."""
    return [c.mark] if c.state.pend and c.state.pend != "T" else [c.last] if c.state.open else []


#: What a stretch does to every state: nothing (None), lead all to one configuration, or a table of configurations.
Function = None | Config | dict[State, Config]


def function_of(syms: Sequence[tuple], places: Sequence[int], begin: int) -> Function:
    """The function of the symbols from number ``begin`` on."""
    if begin == len(syms):
        return None
    table = TABLE
    threads = {Config(s, -1, -2): [s] for s in states()}
    at = begin
    while at < len(syms) and len(threads) > 1:
        row, pos = table[syms[at]], places[at]
        at += 1
        moved: dict[Config, list[State]] = {}
        for (s, last, pend_at), starts in threads.items():
            s, _, moves, mark_ = row[s]
            if mark_:
                pend_at = pos if mark_ == 1 else last
            if moves:
                last = pos
            # registers that cannot matter any more
            c = Config(s, last if s.open else 0, pend_at if s.pend else 0)
            held = moved.get(c)
            if held is None:
                moved[c] = starts
            elif len(held) < len(starts):
                starts.extend(held)
                moved[c] = starts
            else:
                held.extend(starts)
        threads = moved
    if len(threads) == 1:
        (c,) = threads
        if not {c.last, c.mark} & {-1, -2}:
            return read(zip(syms[at:], places[at:]), c, None) if at < len(syms) else c
        rest = read(zip(syms[at:], places[at:]), c, None)
        return {s: rest for s in states()}
    return {s: c for c, starts in threads.items() for s in starts}


def apply(f: Function, c: Config) -> Config:
    """The configuration behind a stretch, from the one before."""
    if f is None:
        return c
    if isinstance(f, Config):
        return f
    end = f[c.state]
    fill = lambda r: c.last if r == -1 else c.mark if r == -2 else r
    return Config(end.state, fill(end.last), fill(end.mark))


def then(f: Function, g: Function) -> Function:
    """The function of two neighbouring stretches."""
    if f is None or isinstance(g, Config):
        return g
    if g is None:
        return f
    return apply(g, f) if isinstance(f, Config) else {s: apply(g, c) for s, c in f.items()}
