"""Secret scans: fixed patterns, and assignment-aware lexing.

Three fixed patterns give the base spans. Around every assignment sign the text is then read as source or
configuration: a name on the left; literals, names and their concatenations on the right. Names that stand for
literals are propagated (a later `password = KEY` points at the literal that KEY was given), and a literal is
reported when what its target is called, and the literal itself, look secret enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_steps

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: The longest possible matches of AKIA[A-Z0-9]+ and [0-9a-f]+ that are long enough; shorter ones are dropped either way.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "named")

_SIGN = re.compile(r":=|=>|(?<![=!<>:])=(?![=>~])|:(?![:=/])")
#: Read from the sign to the left, in reversed text: a name with a type behind it, and a name. Lengths have no limit.
_TYPED = re.compile(r"""[ \t]*+\w++[ \t]*+:(?!:)[ \t]*+["'\])]*+([\w.\-]*[A-Za-z_])""", re.A)
_NAMED = re.compile(r"""[ \t]*+["'\])]*+([\w.\-]*[A-Za-z_])""", re.A)
_BLANKS = re.compile(r"[ \t]*+")
#: A quoted literal, by what it opens with: escapes count; else it may go on over lines up to a blank one; else a
#: backslash is itself; else, without a closing quote, it ends with the line.
_PREFIX = re.compile(r"""[rRbBuUfFLN@$]{1,2}(?=["'`])""")
_QUOTED = {
    **{q * 3: [re.compile(rf"{q * 3}((?:[^{q}\\]++|\\.|{q}(?!{q * 2}))*+){q * 3}", re.S)] for q in "\"'`"},
    "`": [re.compile(r"`((?:[^`\\]++|\\.)*+)`", re.S), re.compile(r"`([^`]*+)`"), re.compile(r"`([^\n]*+)")],
    **{q: [re.compile(x, re.S) for x in (rf"{q}((?:[^{q}\\\n]++|\\.)*+){q}", rf"{q}((?:[^{q}\\\n]++|\\.|\n(?![ \t\r]*\n))*+){q}", rf"{q}([^{q}\n]*+){q}", rf"{q}([^\n]*+)")] for q in "\"'"},
}
#: A block of lines further in than the first of them, behind | or >.
_BLOCK = re.compile(r"[ \t]*+[|>][+\-0-9]*+[ \t]*+\r?\n([ \t]++)([^\s][^\n]*+(?:\n\1[^\n]*+|\n[ \t]*+(?=\n))*+)")
_BARE = re.compile(r"""[^\s"'`,;#<>{}()\[\]]++""")
#: What joins another part to a quoted literal and to a bare value.
_MORE = re.compile(r"""[ \t]*+(?:\+[ \t]*+(?:\\?\r?\n[ \t]*+)?|\.(?:[ \t]++|(?=["'`]))|\\?\r?\n[ \t]*+[+.][ \t]*+(?=["'`]))|(?=["'`])""")
_PLUS = re.compile(r"""[ \t]*+(?:[+.](?:[ \t]++|(?=["'`])|\\?\r?\n[ \t]*+)|\\?\r?\n[ \t]*+[+.][ \t]*+(?=["'`]))""")
#: Names joined by + without blanks, at the start of a bare value.
_SUM = re.compile(r"[A-Za-z_][\w.]*+(?:\+[A-Za-z_][\w.]*+)*+\+?", re.A)
_NAME = re.compile(r"[A-Za-z_][\w.\-]*+", re.A)
_WORD = re.compile(r"[A-Za-z_][\w.]*+", re.A)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: How much a part of a name says that its value is secret.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "apikey": 3, "token": 2, "credential": 2, "credentials": 2, "auth": 1, "key": 1, "private": 2, "access": 1, "api": 1, "bearer": 2, "signing": 1, "session": 1, "client": 1}
#: Types that stand between a name and its value, and are no names themselves.
TYPES = {"str", "string", "bytes", "byte", "char", "text", "varchar", "any", "object", "optional", "int", "float", "number", "bool", "boolean"}
#: Values that stand for none.
PLACEHOLDERS = {"none", "null", "true", "false", "changeme", "example", "password", "secret", "token", "test", "undefined", "your", "xxx"}
#: Name and literal scores that a reported literal reaches together, shortest literal.
NEEDED, SHORTEST = 4.0, 6


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping in each kind, without those that are too short."""
    out = [Span(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [Span(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max(SENSITIVE.get("".join(parts), 0), sum(SENSITIVE.get(p, 0) for p in parts))


def literal_score(literal: str, counts: Counter[str] | None = None) -> float:
    """Randomness in bits a character, with a bonus for mixed classes; a placeholder, a word or a path scores nothing."""
    n, counts = len(literal), Counter(literal) if counts is None else counts
    if n < SHORTEST or set(counts) <= set("xX*.-_") or n <= 16 and literal.lower() in PLACEHOLDERS or all(map(str.isalpha, counts)) and (literal.islower() or literal.istitle()):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit))
    return min(4.0, bits) - 1.5 + 0.5 * (classes - 1) if " " not in counts else min(1.0, bits / 4)


class _Lexer:
    """What names of a text stand for, as a graph: a node has a place in the text or none, and the earlier nodes that it goes on with.

    Chains that end alike share nodes, so neither long concatenations nor names built on names grow with their square.
    """

    def __init__(self, text: str):
        self.text, self.back = text, text[::-1]
        self.nodes: list[tuple[tuple[int, int] | None, tuple[int, ...]]] = []
        self.given: dict[str, int] = {}  # name: node
        self.chains: dict[int, int] = {}  # start of a part: node
        self.run = (0, 0)  # the last bare value: signs inside it have the same end

    def names(self, at: int) -> list[str]:
        """The name to the left of a sign; with a type behind it, the name before that too."""
        found = (p.match(self.back, len(self.text) - at) for p in (_TYPED, _NAMED))
        return list(dict.fromkeys(m[1][::-1] for m in found if m))

    def quoted(self, at: int) -> tuple[tuple[int, int], int] | None:
        """Place of the literal whose quote stands at this place, and its end."""
        q = self.text[at : at + 1]
        for opens in (q * 3, q):
            if self.text.startswith(opens, at):
                for pattern in _QUOTED[opens]:
                    if m := pattern.match(self.text, at):
                        return m.span(1), m.end()
        return None

    def bare(self, at: int) -> int:
        """End of the bare value from here; at itself if there is none."""
        if not self.run[0] <= at < self.run[1]:
            m = _BARE.match(self.text, at)
            self.run = m.span() if m else (at, at)
        return self.run[1]

    def parts(self, start: int, end: int) -> list[tuple[int, int] | int]:
        """A bare value's parts: nodes of the known names in it, and all of it unless it is only names."""
        text, given = self.text, self.given
        name = _NAME.match(text, start, end)
        if not name:
            return [(start, end)]
        known = lambda w: w[0] in given and text[w.end() : w.end() + 1] != "("
        if name.end() == end and known(name):
            return [given[name[0]]]
        names = _SUM.match(text, start, end)
        words = list(_WORD.finditer(text, *names.span()))
        # A + before a quote joins.
        if names.end() == end and (any(map(known, words)) or text[end - 1] == "+" and text[end : end + 1] in tuple("\"'`")):
            return [given[w[0]] if known(w) else w.span() for w in words]
        return [*(given[w[0]] for w in words if known(w)), (start, end)]

    def value(self, at: int) -> int | None:
        """Node of the concatenation to the right of a sign."""
        text, found, tail = self.text, [], None
        if (block := _BLOCK.match(text, at)) and text[at - 1] == ":":
            self.nodes.append((block.span(2), ()))
            return len(self.nodes) - 1
        at = _BLANKS.match(text, at).end()
        while at not in self.chains:
            start = at
            prefix = _PREFIX.match(text, at)
            opens = prefix.end() if prefix else at
            if text[opens : opens + 1] in tuple("\"'`"):
                place, at = self.quoted(opens)
                found.append((start, [place]))
                more = _MORE.match(text, at)
            elif (end := self.bare(at)) > at:
                found.append((start, self.parts(at, end)))
                at = end
                more = _PLUS.match(text, at - (end - start > 1 and text[end - 1] == "+"))
            else:
                break
            if not more:
                break
            at = more.end()
        else:
            tail = self.chains[at]
        for start, parts in reversed(found):
            place = next((x for x in parts if isinstance(x, tuple)), None)
            others = [x for x in parts if isinstance(x, int)]
            for x in [x for x in parts if isinstance(x, tuple)][1:]:
                self.nodes.append((x, ()))
                others.append(len(self.nodes) - 1)
            self.nodes.append((place, (*others, *([] if tail is None else [tail]))))
            tail = self.chains[start] = len(self.nodes) - 1
        return tail

    def places(self) -> dict[tuple[int, int], float]:
        """The best name score of each place."""
        targets = []
        for sign in _SIGN.finditer(self.text):
            names = self.names(sign.start())
            if names and (node := self.value(sign.end())) is not None:
                self.given.update({n: node for n in names if n.lower() not in TYPES})
                targets.append((node, max(map(name_score, names))))
        score = [0.0] * len(self.nodes)
        for node, x in targets:
            score[node] = max(score[node], x if x >= 2 else 0)
        out: dict[tuple[int, int], float] = {}
        for i in range(len(self.nodes) - 1, -1, -1):
            place, on = self.nodes[i]
            if not score[i]:
                continue
            for j in on:
                score[j] = max(score[j], score[i])
            if place:
                out[place] = max(out.get(place, 0), score[i])
        return out


def named_spans(text: str) -> list[Span]:
    """Literals that the text assigns, directly or by way of other names, to sensitive names.

    A bare value ends at a blank, a quote or one of , ; # < > { } ( ) [ ].
    """
    out = []
    counts, last = Counter(), (0, 0)
    # By end: what signs inside a bare value assign ends where it does, and is counted once.
    for (s, e), score in sorted(_Lexer(text).places().items(), key=lambda x: (x[0][1], x[0][0])):
        if e == last[1]:
            counts.subtract(text[last[0] : s])
            counts = +counts
        else:
            counts = Counter(text[s:e])
        last = (s, e)
        if (x := literal_score(text[s:e], counts)) > 0 and score + x >= NEEDED:
            out.append(Span(s, e, "named"))
    return out


def find(text: str | None) -> list[Span]:
    """All spans of a text, base ones included; a null text has none."""
    if not text:
        return []
    more = named_spans(text) if "=" in text or ":" in text else []
    return ordered(base_spans(text) + more)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, spans (array of kind, start, end; code points, end exclusive; by start, then kind).

    Kinds are assign, access, hex (the fixed patterns) and named (from lexing assignments). Null and empty texts have
    no spans. Null or repeated ids are kept as rows of their own. An empty table gives no rows; further columns are
    not looked at.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": s.kind, "start": s.start, "end": s.end} for s in find(t)] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_steps(d, kernel, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """scan()'s rows with counts of base spans, a hash of these, and all spans as text."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scanned.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones together, replaced by mark."""
    if not text:
        return text
    spans = sorted((s.start, s.end) for s in find(text))
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text
