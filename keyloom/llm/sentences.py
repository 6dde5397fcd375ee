"""Sentence boundaries in prose with typesetting markup, for many languages and scripts.

A text is read in two coupled parts:

* the markup part knows where prose is: before, in or after the document body, in mathematics,
  in a figure, in a switched-off block, or so deep in an argument that is skipped. It turns prose into
  the symbols of a small alphabet, whatever the sentence part's state;
* the sentence part is a finite transducer over these symbols, compiled into a table (``transducer``).

Documents beyond ``CHUNK`` characters are cut at line ends; each chunk becomes a state-transition function
(from every markup and sentence state to those behind the chunk). The functions are composed by a
prefix scan: blocks of neighbours bottom-up, all blocks of a level in parallel, then the states before
each block top-down; at last every chunk emits its boundaries from its true start state.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import transducer as T
from keyloom.llm.transducer import Config, Function
from keyloom.runtime import durable, spread

#: Characters after which a text is cut, at the next place where no token can stand across the cut.
CHUNK = 1 << 16
#: What a chunk sees of the next one and of the one before.
AHEAD, BEHIND = 64, 32
#: Neighbours that one task of the scan composes.
FAN = 16

# Abbreviations, without their last full stop.
#: They never end a sentence while text follows.
NEVER = (
    "Dr Prof Mr Mrs Ms St Mme Mlle MM Hr Fr Sr Jr Gen Rev Hon "
    "Fig Figs Eq Eqs Sec Secs Sect Sects Ref Refs Thm Lem Prop Cor Def App Vol Vols Ch Chap Tab Alg No Nos Nr Abb Bd Kap Aufl "
    "fig figs eq eqs sec sect ref refs thm vol no nos nr pp p ff cf Cf cp vgl Vgl viz vs ca approx min max resp env éq "
    "e.g i.e E.g I.e z.B d.h u.a z.T i.A bzw bspw sog inkl ggf evtl ex chap art "
    "см рис табл проф ок им гл стр ред напр акад доц т е г ул д-р"
).split()
NEVER += ["z. B", "d. h", "د", "أ", "डॉ", "प्रो", "श्री", "पृ"]
#: They may end a sentence.
MAYBE = "etc al usw a.u u.s.w ibid Inc Ltd Co д п др".split()
#: After a day they go on with the date.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
#: Environments by what they hold.
DISPLAYS = "equation align gather multline eqnarray displaymath math flalign alignat dmath subequations".split()
FLOATS = "figure table tabular wrapfigure verbatim lstlisting tikzpicture picture algorithm array filecontents".split()
#: Commands with an argument that is no prose and ends a paragraph, and those whose argument is left out of the sentence.
HEADINGS = "part chapter section subsection subsubsection paragraph subparagraph title author date thanks address email keywords affiliation".split()
ASIDES = "footnote footnotetext footnotemark marginpar todo index hspace vspace vskip hskip input include includegraphics includeonly caption label usepackage documentclass documentstyle newtheorem".split()
DEFINITIONS = "newcommand renewcommand providecommand DeclareMathOperator def newenvironment let".split()
#: Commands that only change the look; what they enclose is prose.
LOOKS = "emph textbf textit textsc textsl texttt textrm textup underline text mbox it bf sc tt sl rm em bfseries itshape scshape normalfont small large noindent centering par quad qquad protect".split()
STARTED = "maketitle tableofcontents listoffigures listoftables newpage clearpage pagebreak bigskip medskip smallskip appendix".split()

_STOPS = r"\\%$\n\r.!?。．｡？！।॥؟۔…{}\"“”„«»「」『』()\[\]（）`'"
TOKEN = re.compile(
    rf"""([^{_STOPS}]+)                                   # 1 text
    |(\r?\n[ \t\r]*\n[ \t\r\n]*)                          # 2 paragraph
    |(\r?\n|\r)                                           # 3 line end
    |(\.\.\.+|…+|[.!?]+|[。．｡？！।॥؟۔]+)                 # 4 mark
    |(\\(?:[a-zA-Z@]+\*?|.|\Z))                           # 5 command
    |(\$\$|\$(?:[^$\\\n]|\\[^\n])*\$|\$)                  # 6 dollar
    |(%[^\n]*)                                            # 7 comment
    |([{{}}])                                             # 8 brace
    |(``|[“„«「『(\[（])                                  # 9 opener
    |(''|[”»」』)\]）])                                   # 10 closer
    |(["'`])                                              # 11 upright
    """,
    re.X,
)
_ARG = re.compile(r"\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_OPTION = re.compile(r"\*?(?:\[[^\]\n]*\])+")
_ENV = re.compile(r"\{([a-zA-Z*]+)\}(?:\[[^\]\n]*\])?")
_PAREN_MATH = re.compile(r"(?:[^\\\n]|\\[^)\n])*\\\)")
_NAME = re.compile(r"\\[a-zA-Z@]+|\{\\[a-zA-Z@]+\}")
_THAI_GAP = re.compile("(?<=[\u0e00-\u0e7f])[ \t]+(?=[\u0e00-\u0e7f])")
_BEFORE = re.compile(r"(?:^|(?<=[\s~(\[{«“„‘’'`\"（「\\,;/–—-]))((?:[^\W\d_]|[\u0900-\u097f])(?:[^\W\d_]|[\u0900-\u097f]|[.-](?=\w))*|\d{1,2})$")
_NEVER, _MAYBE, _MONTHS = frozenset(NEVER), frozenset(MAYBE), tuple(MONTHS)
#: A line end behind which a line begins; what may begin a token that goes on over blanks; a blank between two words; Thai.
_CUT, _SPECIAL, _BLANK, _THAI = re.compile(r"\n(?![\r\n \t])"), re.compile(r"[\\%${}\[]"), re.compile(r"(?<=\w) (?=\w)"), re.compile("[\u0e00-\u0e7f]")
#: In each state outside prose, the characters that can matter there.
_JUMP = {**dict.fromkeys(("pre", "display", "float", "off", "iffalse", "bracket"), re.compile(r"[\\%]")), **dict.fromkeys(("aside", "heading"), re.compile(r"[\\%{}]")), **dict.fromkeys(("dollar", "paren"), re.compile(r"[\\%$\r\n]"))}
_BEGIN = re.compile(r"^[^%\n]*?\\begin\{document\}", re.M)
_KIND = {**dict.fromkeys(DISPLAYS, "display"), **dict.fromkeys(FLOATS, "float"), "comment": "off"}
_DO = {**dict.fromkeys(HEADINGS, "heading"), **dict.fromkeys(ASIDES, "aside"), **dict.fromkeys(DEFINITIONS, "define"), **dict.fromkeys(LOOKS, "look"), **dict.fromkeys(STARTED, "break")}
_DO |= {"item": "item", "begin": "begin", "end": "end", "bibliography": "stop", "bibliographystyle": "stop", "iffalse": "iffalse", "fi": "look", "else": "look", "iftrue": "look"}


class Markup(NamedTuple):
    """Where the reader is: pre, body, stop; display, float, off (an environment), dollar, dollars, paren, bracket (mathematics), iffalse, aside, heading (with a depth), wait-aside, wait-heading (an argument is due)."""

    mode: str = "body"
    depth: int = 0


#: Markup states without a depth, and those with one, of which there are as many as a text has depths.
FLAT = ("pre", "body", "stop", "display", "float", "off", "dollar", "dollars", "paren", "bracket", "wait-aside", "wait-heading")
NESTED = ("iffalse", "aside", "heading")


def _class(c: str) -> str:
    if "฀" <= c <= "๿":
        return "thai"
    if c.isalpha():
        return "low" if c.islower() else "up" if c.isupper() or c.istitle() else "plain"
    return "digit" if c.isdigit() else "plain" if "ऀ" <= c <= "ॿ" else "punct"


def _unit(text: str, at: int) -> bool:
    """Whether a single capital letter at this place is the unit of a number."""
    before = text[max(0, at - 2) : at]
    return len(before) == 2 and before[1] == "~" and (before[0].isdigit() or before[0] == "%")


def _mark(text: str, at: int, skip: int) -> tuple:
    """The symbol of the end marks text[at:skip]."""
    marks, nxt = text[at:skip], text[skip : skip + 1]
    if marks == "." and (nxt.isalnum() or "ऀ" <= nxt <= "ॿ"):
        return T.JOIN
    if marks == "．" and nxt.isdigit() and text[at - 1 : at].isdigit():
        return T.WIDE
    if marks[0] == "…" or marks.startswith(".."):
        kind = "F"
    elif marks[0] in "。．｡？！।॥؟۔":
        kind = "E"
    elif marks == "." and nxt == "~":  # a tie keeps what stands on its sides together
        kind = "N"
    else:
        kind = "A"
        if marks == "." and (b := _BEFORE.search(text, max(0, at - 16), at)):
            w = b.group(1)
            if w in _NEVER or (len(w) == 1 and w.isupper() and not _unit(text, b.start(1))):
                kind = "N"
            elif w in _MAYBE:
                kind = "B"
            elif w.isdigit():
                kind = "O"
    return T.mark(kind, marks[-1] in ".…")


def _ahead(text: str, skip: int) -> str:
    """The class of what an opener stands before."""
    rest = text[skip : skip + AHEAD].lstrip(" \t\n\r~“„«「『(（[`\"'")
    return _class(rest[0]) if rest else "sign"


def lex(text: str, start: int, stop: int, base: int, markup: Markup, more: bool, end: list, seen: dict | None = None, known: dict | None = None) -> Iterator[tuple]:
    """The (symbol, place) pairs of text[start:stop]; places are 1-based, and ``base`` is what text[0] lacks to its place in the document.

    ``more``: whether a $$ comes behind ``stop``. The markup state behind is put into ``end``. Into
    ``seen`` go the places where a token of the body begins, with the number of symbols before them; at
    such a place in ``known`` the reading stops, and the place is put into ``end``.
    """
    mode, depth = markup
    match = TOKEN.match
    skip, size, count = start, stop, 0
    while skip < size:
        if mode == "body":
            if seen is not None:
                seen.setdefault(skip, count)
            elif known is not None and skip in known:
                end.append(skip)
                return
        elif mode in _JUMP:
            j = _JUMP[mode].search(text, skip, size)
            if not j:
                break
            skip = j.start()
        elif mode == "dollars":
            # a display between double dollars ends at the next pair
            close = text.find("$$", skip, size)
            if close < 0:
                break
            mode, skip = "body", close + 2
            continue
        elif mode == "stop":
            break
        m = match(text, skip, size)
        if m is None:  # no token starts here only if the pattern lacks a character
            skip += 1
            continue
        kind, at, skip = m.lastindex, skip, m.end()
        # ---- outside prose -----------------------------------------------------------------
        if kind == 7:
            continue
        if mode != "body":
            if mode.startswith("wait-"):
                if kind == 8 and text[at] == "{":
                    mode, depth = mode[5:], 1
                    continue
                if kind == 3 or (kind == 1 and text[at:skip].isspace()):
                    continue
                mode = "body"  # no argument came; the token is read as prose below
        if mode != "body":
            if kind == 5:
                name = text[at + 1 : skip].rstrip("*")
                if mode == "pre":
                    if name == "begin" and text.startswith("{document}", skip):
                        mode, skip = "body", skip + 10
                elif mode in ("display", "float", "off"):
                    if name == "end" and (e := _ENV.match(text, skip)) and _KIND.get(e.group(1).rstrip("*")) == mode:
                        mode, skip = "body", e.end()
                elif mode == "iffalse":
                    if name.startswith("if"):
                        depth += 1
                    elif name == "fi" or (name == "else" and depth == 1):
                        depth -= 1
                        mode = mode if depth else "body"
                elif mode == "paren" and name == ")":
                    mode = "body"
                    yield T.HERE, base + skip
                    count += 1
                elif mode == "bracket" and name == "]":
                    mode = "body"
            elif kind == 6 and mode == "dollar":
                mode = "body"
                yield T.HERE, base + skip
                count += 1
            elif kind == 8 and mode in ("aside", "heading"):
                depth += 1 if text[at] == "{" else -1
                mode = mode if depth else "body"
            elif kind == 2 and mode in ("dollar", "paren"):
                mode = "body"
                skip = at  # the paragraph end is read again, as prose
            continue
        # ---- prose ---------------------------------------------------------------------------
        if kind == 1:
            token = text[at:skip]
            bare = token.lstrip(" \t~　 ")
            if not bare:
                sym, pos = T.GAP, 0
            else:
                lead = len(token) - len(bare)
                if lead:
                    yield (T.TIE if "~" in token[:lead] else T.GAP), 0
                    count += 1
                last = at + len(token.rstrip(" \t~　 "))
                cls, c, pos = _class(bare[0]), text[last - 1], base + last
                thai = "฀" <= c <= "๿"
                sym = T.word(cls, bare.startswith(_MONTHS), thai, thai and last < skip and "~" not in text[last:skip])
                if cls != "punct" and " " in bare and "฀" <= max(bare):
                    inner = [g.start() for g in _THAI_GAP.finditer(text, at, skip) if g.start() < last]
                    if inner:
                        # a pending mark is dealt with before the gaps, as the token begins before them
                        yield sym, pos
                        count += 1 + len(inner)
                        for g in inner:
                            yield T.END, base + g
                        continue
        elif kind == 3:
            sym, pos = T.GAP, 0
        elif kind == 4:
            sym, pos = _mark(text, at, skip), base + skip
        elif kind == 2:
            sym, pos = T.PARA, 0
        elif kind == 5:
            raw = text[at + 1 : skip]
            name = raw.rstrip("*")
            do = _DO.get(name)
            cls = "macro"
            if do is None:
                if raw in (" ", "\\", "\n", "~", "/", ",", ";", ":", "!", "-", "", "\r"):
                    if raw in ("/", ",", "-", ""):
                        continue
                    sym, pos = T.TIE, 0
                    yield sym, pos
                    count += 1
                    continue
                if raw == "[":
                    mode = "bracket"
                    continue
                if raw == "(":
                    if p := _PAREN_MATH.match(text, skip, size):
                        skip = p.end()
                    else:
                        mode = "paren"
                    cls = "sign"
                elif name.startswith("cite") or name == "nocite":
                    if a := _ARG.match(text, skip):
                        skip = min(a.end(), size)
                    yield T.CITE, base + skip
                    count += 1
                    continue
                elif name.endswith("ref"):
                    if a := _ARG.match(text, skip):
                        skip = min(a.end(), size)
                    cls = "digit"
                elif raw[0].isalpha() or raw[0] == "@":
                    if text.startswith("{}", skip):
                        skip += 2
                elif raw in "'`^\"=.uvHtcdb":
                    # an accent belongs to the letter after it
                    c = text[skip : skip + 3].lstrip("{\\")[:1]
                    cls = _class(c) if c else "low"
                else:
                    cls = "punct" if raw not in ("%", "$", "#", "&", "_", "{", "}") else "digit"
            elif do == "look":
                if len(name) > 2 or not text.startswith("{}", skip):
                    continue
                skip += 2  # a macro of the author's own under a known short name
            elif do == "iffalse":
                mode, depth = "iffalse", 1
                continue
            elif do in ("aside", "define"):
                if do == "define" and (d := _NAME.match(text, skip)):
                    skip = d.end()
                if o := _OPTION.match(text, skip):
                    skip = o.end()
                mode = "wait-aside"
                continue
            elif do in ("begin", "end"):
                e = _ENV.match(text, skip)
                env = e.group(1).rstrip("*") if e else ""
                skip = min(e.end(), size) if e else skip
                what = _KIND.get(env)
                if what and do == "begin":
                    mode = what
                    if what == "display" or what == "off":
                        continue
                elif what:
                    continue
                cls = ""
                if (env == "document" and do == "end") or (env == "thebibliography" and do == "begin"):
                    mode = "stop"
            else:
                cls = ""
                if do == "heading":
                    mode = "wait-heading"
                    if o := _OPTION.match(text, skip):
                        skip = o.end()
                elif do == "stop":
                    mode = "stop"
                elif do == "item" and (o := _OPTION.match(text, skip)):
                    skip = o.end()
            sym, pos = (T.word(cls, thai="฀" <= text[skip - 1] <= "๿"), base + skip) if cls else (T.PARA, 0)
        elif kind == 6:
            if m.group() == "$$":
                mode = "dollars" if more or text.find("$$", skip, size) >= 0 else "dollar"
                continue
            if skip - at == 1:
                mode = "dollar"
            sym, pos = T.word("sign"), base + skip
        elif kind == 8:
            if text[at] == "{":
                continue
            sym, pos = T.BRACE, base + skip
        elif kind == 11 and text[at] != '"':
            sym, pos = T.UPRIGHT, base + skip
        elif kind == 10:
            c = text[at]
            sym, pos = T.closer(")" if c in ")]）" else "»" if c == "»" else "q"), base + skip
        else:
            c = text[at]
            sym, pos = T.opener("(" if c in "([（" else c if c in '„“"' else "g", _ahead(text, skip)), base + skip
        yield sym, pos
        count += 1
    end.append(Markup(mode, depth))


def first_markup(text: str) -> Markup:
    """Prose starts at the body's begin; in a text without one, at its start."""
    return Markup("pre") if "\\begin{document}" in text and _BEGIN.search(text) else Markup("body")


def sentence_ends(text: str) -> list[int]:
    """1-based positions of the last characters of a text's sentences."""
    out: list[int] = []
    end = T.read(lex(text, 0, len(text), 0, first_markup(text), False, []), Config(), out)
    return out + T.finish(end)


# ---- long documents: chunks as functions, composed by a prefix scan ------------------------------


class Exit(NamedTuple):
    """What becomes of one markup state over a stretch: the markup state behind it, and the function of the sentence states."""

    markup: Markup
    function: Function


class Nest(NamedTuple):
    """A mode with depths over a stretch: what becomes of the depths up to len(out), and what the others change by."""

    out: list[Exit]
    change: int


#: A stretch as a function: mode -> Exit, or Nest for a mode with depths.
Stretch = dict


def cuts(text: str, chunk: int = CHUNK) -> list[int]:
    """Where to cut: behind a line end outside a paragraph end, at the first one ``chunk`` characters on.

    No token stands across such a place. Inside a line it is cut only while no markup and no Thai has come
    in it, behind a blank; a line that gives no such place stays whole.
    """
    at, places = 0, [0]
    while len(text) - at > chunk:
        m = _CUT.search(text, at + chunk)
        end = m.end() if m else len(text)
        line = text.rfind("\n", 0, at + chunk) + 1
        special = _SPECIAL.search(text, line, end)
        if special is None or special.start() > at + chunk:
            b = _BLANK.search(text, at + chunk, special.start() if special else end)
            end = b.start() + 1 if b and not _THAI.search(text, line, end) else end
        at = end
        if at < len(text):
            places.append(at)
    return [*places, len(text)]


def _nest(text: str, start: int, stop: int, mode: str) -> tuple[dict[int, int], int]:
    """For a start in ``mode``: the place where each depth is left, and what the depth has changed by at the end."""
    jump, match, left, change, skip = _JUMP[mode], TOKEN.match, {}, 0, start
    while j := jump.search(text, skip, stop):
        at = j.start()
        m = match(text, at, stop)
        skip = m.end() if m else at + 1
        if m is None or m.lastindex == 7:
            continue
        if m.lastindex == 8 and mode != "iffalse":
            change += 1 if text[at] == "{" else -1
        elif m.lastindex == 5 and mode == "iffalse":
            name = text[at + 1 : skip].rstrip("*")
            if name.startswith("if"):
                change += 1
            elif name == "fi":
                change -= 1
            elif name == "else" and change <= 0:
                left.setdefault(1 - change, skip)
        if change < 0:
            left.setdefault(-change, skip)
    return left, change


def chunk_function(text: str, start: int, stop: int, base: int, more: bool) -> Stretch:
    """The function of a chunk text[start:stop] from every markup state and every sentence state."""
    behind, seen = [], {}
    pairs = list(lex(text, start, stop, base, Markup(), more, behind, seen=seen))
    syms, places = [x for x, _ in pairs], [p for _, p in pairs]
    body_end, made = behind[0], {}

    def from_body(at: int, before: list[tuple]) -> Exit:
        """Prose is read from here, behind some symbols."""
        joined: list = []
        own = before + list(lex(text, at, stop, base, Markup(), more, joined, known=seen))
        if isinstance(joined[0], Markup):
            return Exit(joined[0], T.function_of([x for x, _ in own], [p for _, p in own], 0))
        i = seen[joined[0]]
        if i not in made:
            made[i] = T.function_of(syms, places, i)
        return Exit(body_end, T.then(T.function_of([x for x, _ in own], [p for _, p in own], 0), made[i]))

    f: Stretch = {}
    for mode in FLAT:
        joined: list = []
        own = list(lex(text, start, stop, base, Markup(mode), more, joined, known=seen))
        if isinstance(joined[0], Markup):
            f[mode] = Exit(joined[0], T.function_of([x for x, _ in own], [p for _, p in own], 0))
        else:
            f[mode] = from_body(joined[0], own)
    for mode in NESTED:
        left, change = _nest(text, start, stop, mode)
        f[mode] = Nest([from_body(left[d], []) for d in range(1, len(left) + 1)], change)
    return f


def enter(f: Stretch, m: Markup) -> Exit:
    """What a stretch makes of one markup state."""
    x = f[m.mode]
    if isinstance(x, Exit):
        return x
    return x.out[m.depth - 1] if m.depth <= len(x.out) else Exit(Markup(m.mode, m.depth + x.change), None)


def compose(first: Stretch, second: Stretch) -> Stretch:
    """The function of two neighbouring stretches."""

    def onward(x: Exit) -> Exit:
        y = enter(second, x.markup)
        return Exit(y.markup, T.then(x.function, y.function))

    f: Stretch = {}
    for mode, x in first.items():
        if isinstance(x, Exit):
            f[mode] = onward(x)
            continue
        # depths that the first stretch keeps may be left in the second
        deeper = range(len(x.out) + 1, len(second[mode].out) - x.change + 1)
        out = [onward(e) for e in x.out] + [onward(Exit(Markup(mode, d + x.change), None)) for d in deeper]
        f[mode] = Nest(out, x.change + second[mode].change)
    return f


def through(f: Stretch, m: Markup, c: Config) -> tuple[Markup, Config]:
    """Both states behind a stretch, from those before it."""
    x = enter(f, m)
    return x.markup, T.apply(x.function, c)


# ---- Spark ------------------------------------------------------------------------------------------

_OUT = "doc_id long, end_pos long"
_CHUNKS = "doc_id long, row long, k int, base long, pre boolean, start int, stop int, more boolean, last boolean, text string"


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, ends = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = sentence_ends(t)
            ids += [i] * len(got)
            ends += got
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "end_pos"])


def _chunks(text: str, chunk: int) -> list[tuple]:
    """(k, base, pre, start, stop, more, last, text) of each chunk of a text; its text has some characters before and behind it."""
    at, pre, dollars = cuts(text, chunk), first_markup(text).mode == "pre", text.rfind("$$")
    lows = [max(0, a - BEHIND) for a in at]
    return [(k, low, pre, a - low, z - low, dollars >= z, z == len(text), text[low : z + AHEAD]) for k, (a, z, low) in enumerate(zip(at, at[1:], lows))]


def _cut(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row", "k", "base", "pre", "start", "stop", "more", "last", "text"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    for b in batches:
        for i, t, row in zip(*[c.to_pylist() for c in b.columns]):
            rows = [(i, row, *x) for x in _chunks(t, chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*rows), types)], names=names)


def _functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in frames:
        f = [pickle.dumps(chunk_function(*x)) for x in zip(d["text"], d["start"], d["stop"], d["base"], d["more"])]
        yield pd.DataFrame({"row": d["row"], "k": d["k"], "pre": d["pre"], "f": f})


def _composed(d: pd.DataFrame) -> pd.DataFrame:
    """One function of a block's FAN at most."""
    d = d.sort_values("k")
    whole = pickle.loads(d["f"].iloc[0])
    for x in d["f"].iloc[1:]:
        whole = compose(whole, pickle.loads(x))
    return pd.DataFrame({"row": d["row"].iloc[:1], "k": d["k"].iloc[:1] // FAN, "pre": d["pre"].iloc[:1], "f": [pickle.dumps(whole)]})


def _started(d: pd.DataFrame) -> pd.DataFrame:
    """The state before each of a block's FAN at most, from the one before the block."""
    d = d.sort_values("k")
    m, c = pickle.loads(d["before"].iloc[0])
    out = []
    for x in d["f"]:
        out.append(pickle.dumps((m, c)))
        m, c = through(pickle.loads(x), m, c)
    return pd.DataFrame({"row": d["row"], "k": d["k"], "before": out})


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, ends = [], []
        for i, t, start, stop, base, more, last, before in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "start", "stop", "base", "more", "last", "before")]):
            m, c = pickle.loads(before)
            got: list[int] = []
            c = T.read(lex(t, start, stop, base, m, more, []), c, got)
            got += T.finish(c) if last else []
            ids += [i] * len(got)
            ends += got
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "end_pos"])


def _starts(functions: DataFrame, chunks: int) -> DataFrame:
    """row, k, before (the states before each chunk) from the chunks' functions; a text has ``chunks`` chunks at most."""
    levels, size = [functions], chunks
    while size > FAN:
        levels.append(durable(levels[-1].groupBy("row", F.floor(F.col("k") / FAN).alias("b")).applyInPandas(_composed, functions.schema)))
        size = -(-size // FAN)
    first = {pre: pickle.dumps((Markup("pre" if pre else "body"), Config())) for pre in (True, False)}
    top = F.when(F.col("pre"), F.lit(first[True])).otherwise(F.lit(first[False]))
    before = None
    for level in reversed(levels):
        if before is None:
            known = level.withColumn("before", top).withColumn("b", F.lit(0).cast("long"))
        else:
            known = level.withColumn("b", F.floor(F.col("k") / FAN)).join(before.select("row", F.col("k").cast("long").alias("b"), "before"), ["row", "b"])
        before = known.groupBy("row", "b").applyInPandas(_started, "row long, k int, before binary")
    return before


def sentences(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row (doc_id, end_pos) for each sentence of each document.

    ``docs``: doc_id, text; other columns are not read. Null and empty texts, and texts without prose,
    have no sentences. Repeated and null doc_ids are kept: each row counts. The result does not depend on
    ``chunk``.
    """
    texts = spread(docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.col("text") != "")))
    short = texts.filter(F.length("text") <= chunk).mapInArrow(_short, _OUT)
    # a number for each row, as doc_ids may repeat; fixed by the copy before it is read twice
    numbered = texts.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    parts = durable(numbered.mapInArrow(lambda b: _cut(b, chunk), _CHUNKS).repartition("row", "k"))
    most = parts.agg(F.max("k")).first()[0]
    if most is None:
        return short
    fs = durable(parts.mapInPandas(_functions, "row long, k int, pre boolean, f binary"))
    long = parts.join(_starts(fs, most + 1), ["row", "k"]).mapInArrow(_emit, _OUT)
    return short.union(long)
