"""Problem 2: nested JSON text to linked flat rows, by vectorised structural indexing.

A batch of JSON texts is laid end to end in one byte buffer. One lookup finds the marks (quotes, backslashes, brackets,
delimiters); escapes are resolved by the parity of backslash runs, the inside of strings by the parity of quotes, nesting
depth by the prefix sum of the brackets, all on the marks alone. What lies between two marks is a string, a scalar or white
space, so the marks give the tokens of every text; the grammar is a table of which token may follow which. Sorting the
tokens by (text, depth, place) puts those of each container side by side, so every member of every container of the batch
falls out as a span. A member whose value is a container links to that container by the place of its opening bracket.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTE, _BACKSLASH, _BRACE, _BRACKET = b'"\\{['
# Kinds of tokens. A comma of an object and the string that is a key have kinds of their own; BEGIN and END stand around a text.
_OBJECT, _ARRAY, _OBJECT_END, _ARRAY_END, _COMMA, _COLON, _STRING, _SCALAR, _OBJECT_COMMA, _STRAY_COMMA, _KEY, _BEGIN, _END = range(13)
_KIND = np.full(256, -1, np.int8)
_KIND[list(b"{[}],:")] = range(6)
_MARK = _KIND >= 0
_MARK[[_QUOTE, _BACKSLASH]] = True


def _grammar() -> np.ndarray:
    """may[a, b]: whether token b may follow token a in a JSON text."""
    may = np.zeros((13, 13), bool)
    value, ended = [_OBJECT, _ARRAY, _STRING, _SCALAR], [_COMMA, _OBJECT_COMMA, _OBJECT_END, _ARRAY_END, _END]
    for before in (_BEGIN, _COMMA, _COLON):
        may[before, value] = True
    may[_OBJECT, [_KEY, _OBJECT_END]] = True
    may[_ARRAY, [*value, _ARRAY_END]] = True
    for before in (_OBJECT_END, _ARRAY_END, _STRING, _SCALAR):
        may[before, ended] = True
    may[_OBJECT_COMMA, _KEY] = may[_KEY, _COLON] = True
    return may


_MAY = _grammar()
_IS_VALUE = np.isin(np.arange(13), (_OBJECT, _ARRAY, _STRING, _SCALAR))
_SPACE = b" \t\r\n"
_NUMBER_OR_WORD = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_ESCAPABLE, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True


class StructuralIndex:
    """The members of all containers in a batch of JSON texts.

    ``members``: one row per array element or object entry with ``doc``, ``box`` (place of the container's opening
    bracket), ``pos`` (its number in the container), ``key`` (span ``k0``, ``k1``; -1 in arrays), ``v0``, ``v1`` (value span) and
    ``first`` (first byte of the value). ``roots()``: the span of each valid text. Texts that are null, empty or no valid
    JSON have no root and no members. Texts may be nested to any depth.
    """

    def __init__(self, texts: list[str | None]):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.buffer = b"\n".join(raw) + b"\n"
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if raw else np.zeros(0, np.int64)
        self.ends = self.starts + lengths
        self._b = np.frombuffer(self.buffer, np.uint8)
        self.well_formed = lengths > 0
        self._tokens()

    def _doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def _reject(self, docs: np.ndarray) -> None:
        self.well_formed[docs] = False

    def _strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The structural characters outside strings (place, kind) and the strings (first quote, last quote), with the escapes checked."""
        b = self._b
        at = np.flatnonzero(_MARK[b]).astype(np.int32 if len(b) < 1 << 31 else np.int64)
        byte = b[at]
        slash = byte == _BACKSLASH
        number = np.arange(len(at), dtype=at.dtype)
        follows = np.zeros(len(at), bool)
        follows[1:] = slash[1:] & slash[:-1] & (at[1:] == at[:-1] + 1)
        run = np.maximum.accumulate(np.where(slash & ~follows, number, 0)) if len(at) else number
        escaping = slash & ((number - run) % 2 == 0)
        escaped = np.zeros(len(at), bool)
        escaped[1:] = escaping[:-1] & (at[1:] == at[:-1] + 1)
        quote = (byte == _QUOTE) & ~escaped
        # Quotes are counted from the beginning of each text.
        doc = self._doc(at)
        counted = np.cumsum(quote, dtype=at.dtype)
        before = np.concatenate([[0], counted])[np.searchsorted(at, self.starts)]
        odd = (counted - before[doc]) % 2 == 1
        opened, closed = at[quote & odd], at[quote & ~odd]
        if len(opened) != len(closed):
            # A string that is never closed ends with its text, which is no JSON.
            ends_open = np.flatnonzero((np.concatenate([[0], counted])[np.searchsorted(at, self.ends)] - before) % 2 == 1)
            self._reject(ends_open)
            closed = np.sort(np.concatenate([closed, self.ends[ends_open].astype(at.dtype)]))
        escape = self._escapes = at[escaping & odd]
        wrong = ~_ESCAPABLE[b[escape + 1]]
        coded = b[escape + 1] == ord("u")
        for step in range(2, 6):
            wrong |= coded & ~_HEX[b[np.minimum(escape + step, len(b) - 1)]]
        self._reject(self._doc(escape[wrong]))
        control = np.flatnonzero(b < 32)
        if len(opened) and len(control):
            holder = np.searchsorted(opened, control, "right") - 1
            self._reject(self._doc(control[(holder >= 0) & (control < closed[np.maximum(holder, 0)])]))
        structural = (_KIND[byte] >= 0) & ~odd
        return at[structural], _KIND[byte[structural]], opened, closed, doc[structural]

    def _scalars(self, t0: np.ndarray, t1: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans of numbers and words: what is not white space between two tokens."""
        first = np.ones(len(t0), bool)
        first[1:] = doc[1:] != doc[:-1]
        begin = np.where(first, self.starts[doc], np.concatenate([[0], t1[:-1]]))
        last = np.searchsorted(t0, self.ends) - 1
        has = (last >= 0) & (np.searchsorted(t0, self.starts) <= last)
        begin = np.concatenate([begin, np.where(has, t1[np.maximum(last, 0)] if len(t1) else 0, self.starts)])
        end = np.concatenate([t0, self.ends])
        wide = end - begin
        some = (wide > 1) | ((wide == 1) & (self._b[np.minimum(begin, len(self._b) - 1)] != 32))
        known: dict[bytes, bool] = {}
        spans = []
        for a, z in zip(begin[some].tolist(), end[some].tolist()):
            piece = self.buffer[a:z]
            said = piece.strip(_SPACE)
            if said:
                right = known.get(said)
                if right is None:
                    right = known[said] = _NUMBER_OR_WORD.fullmatch(said) is not None
                a += piece.index(said)
                spans.append((a, a + len(said), right))
        v0, v1, right = (np.array(x) for x in zip(*spans)) if spans else (np.zeros(0, t0.dtype), np.zeros(0, t0.dtype), np.zeros(0, bool))
        self._reject(self._doc(v0[~right.astype(bool)]))
        return v0.astype(t0.dtype), v1.astype(t0.dtype)

    def _tokens(self) -> None:
        """Tokens of all texts, their grammar, and the members of the containers of the valid texts."""
        at, kind, opened, closed, _ = self._strings()
        t0 = np.concatenate([at, opened])
        order = np.argsort(t0, kind="stable")
        t0 = t0[order]
        t1 = np.concatenate([at + 1, closed + 1])[order]
        kind = np.concatenate([kind, np.full(len(opened), _STRING, np.int8)])[order]
        s0, s1 = self._scalars(t0, t1, self._doc(t0))
        order = np.argsort(np.concatenate([t0, s0]), kind="stable")
        t0, t1 = np.concatenate([t0, s0])[order], np.concatenate([t1, s1])[order]
        kind = np.concatenate([kind, np.full(len(s0), _SCALAR, np.int8)])[order]
        doc = self._doc(t0)

        opens, closes = kind <= _ARRAY, (kind == _OBJECT_END) | (kind == _ARRAY_END)
        depth = np.concatenate([[0], np.cumsum(opens.astype(np.int32) - closes)])
        begin = np.searchsorted(t0, self.starts)
        stop = np.searchsorted(t0, self.ends)
        self._reject(np.flatnonzero((begin == stop) | (depth[stop] != depth[begin])))
        # Content has the depth of its container's brackets, a bracket's own place the depth around it.
        level = depth[1:] - depth[begin[doc]] + closes
        self._reject(doc[level < closes])

        ok = self.well_formed[doc]
        t0, t1, kind, doc, level, opens, closes = (x[ok] for x in (t0, t1, kind, doc, level, opens, closes))
        # A container is listed as a member of the one around it, too.
        inner = np.flatnonzero(opens)
        token = np.concatenate([np.arange(len(t0)), inner])
        as_member = np.concatenate([~opens & ~closes, np.ones(len(inner), bool)])
        around = np.concatenate([level, level[inner] - 1])
        order = np.lexsort((token, around, doc[token]))
        token, as_member, around = token[order], as_member[order], around[order]
        rank = np.arange(len(token))
        bracket = opens[token] & ~as_member
        last_open = np.maximum.accumulate(np.where(bracket, rank, 0)) if len(rank) else rank
        box = token[last_open]
        at_root = around == 0
        in_object = (kind[box] == _OBJECT) & ~at_root

        comma = (kind[token] == _COMMA) & as_member
        kind[token[comma & in_object]] = _OBJECT_COMMA
        kind[token[comma & at_root]] = _STRAY_COMMA
        self._reject(doc[token[closes[token] & ((kind[token] == _OBJECT_END) != in_object)]])
        previous = np.concatenate([[_BEGIN], kind[:-1]]) if len(kind) else kind
        if len(kind):
            previous[1:][doc[1:] != doc[:-1]] = _BEGIN
        kind[(kind == _STRING) & ((previous == _OBJECT) | (previous == _OBJECT_COMMA))] = _KEY
        if len(kind):
            previous[1:] = np.where(doc[1:] != doc[:-1], _BEGIN, kind[:-1])
            self._reject(doc[~_MAY[previous, kind]])
            ends = np.concatenate([doc[1:] != doc[:-1], [True]])
            self._reject(doc[ends & ~_MAY[kind, _END]])

        # The end of a container is that of its closing bracket.
        close = closes[token]
        t1[box[close]] = t1[token[close]]
        value = as_member & _IS_VALUE[kind[token]] & self.well_formed[doc[token]]
        commas = np.cumsum((kind[token] == _COMMA) | (kind[token] == _OBJECT_COMMA))
        key = np.maximum.accumulate(np.where(kind[token] == _KEY, rank, 0)) if len(rank) else rank
        members = value & ~at_root
        k = token[key[members]]
        entry = in_object[members]
        v = token[members]
        self.members = pd.DataFrame(
            {
                "doc": doc[v], "box": t0[box[members]], "k0": np.where(entry, t0[k], -1), "k1": np.where(entry, t1[k], -1), "v0": t0[v], "v1": t1[v],
                "first": self._b[t0[v]], "pos": (commas - commas[last_open])[members] if len(rank) else rank[:0],
            }
        )
        r = token[value & at_root]
        self._roots = pd.DataFrame({"doc": doc[r], "v0": t0[r], "v1": t1[r], "first": self._b[t0[r]]})

    def roots(self) -> pd.DataFrame:
        """doc, v0, v1, first of each valid text."""
        return self._roots

    def text(self, v0: int, v1: int) -> str:
        """A span as text; a JSON string without its quotes and escapes. Half of a surrogate pair becomes a replacement mark."""
        span = self.buffer[v0:v1]
        if span[:1] != b'"':
            return span.decode("utf-8", "replace")
        if b"\\" not in span:
            return span[1:-1].decode("utf-8", "replace")
        return json.loads(span).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    def keyed(self, members: pd.DataFrame, key: str) -> pd.DataFrame:
        """The entries named ``key``; of one named twice in a container the last, as JSON readers take it."""
        plain = b'"' + key.encode() + b'"'
        k0, k1 = members["k0"].to_numpy(), members["k1"].to_numpy()
        escaped = np.searchsorted(self._escapes, k1) > np.searchsorted(self._escapes, k0)
        hit = (k1 - k0 == len(plain)) & ~escaped
        hit[hit] = [self.buffer[a:b] == plain for a, b in zip(k0[hit].tolist(), k1[hit].tolist())]
        hit[escaped] = [self.text(a, b) == key for a, b in zip(k0[escaped].tolist(), k1[escaped].tolist())]
        return members[hit].drop_duplicates("box", keep="last")


def _entries(index: StructuralIndex, holders: pd.DataFrame) -> pd.DataFrame:
    """The members of the containers at holders.v0, with the holders' other columns."""
    side = holders.drop(columns=[c for c in ("doc", "v1", "first", "box", "k0", "k1", "pos") if c in holders]).rename(columns={"v0": "box"})
    return index.members.merge(side, on="box", how="inner")


_VALUE = ["owner", "place", "outer", "v0", "v1", "first"]


def _elements(index: StructuralIndex, value: pd.DataFrame, value_key: str, field: str | None) -> tuple[pd.DataFrame, list[tuple[int, int, bool, str]]]:
    """(the array elements that are objects, the texts still to be indexed) of one round of :func:`_children`.

    ``value``: owner, place (-1 for the array itself), outer (whether ``field`` must still be looked up) and the span. Texts to be
    indexed are (owner, place, outer, text).
    """
    again = [(o, p, f, index.text(a, b)) for o, p, f, a, b in value.loc[value["first"] == _QUOTE, _VALUE[:5]].itertuples(index=False)]
    nested = value[value["outer"] & (value["first"] == _BRACE)]
    value = value[~value["outer"] & value["first"].isin([_BRACE, _BRACKET])]
    if len(nested):
        inner = index.keyed(_entries(index, nested[["owner", "v0"]]), field).assign(place=-1, outer=False)
        again += [(o, -1, False, index.text(a, b)) for o, a, b in inner.loc[inner["first"] == _QUOTE, ["owner", "v0", "v1"]].itertuples(index=False)]
        value = pd.concat([value, inner.loc[inner["first"].isin([_BRACE, _BRACKET]), _VALUE]])
    # Objects of a single entry whose value is a container are wrappings.
    while len(objects := value[(value["first"] == _BRACE) & (value["place"] < 0)]):
        entries = _entries(index, objects[["owner", "v0"]])
        single = entries[entries.groupby("box")["pos"].transform("size") == 1]
        single = single[~single["v0"].isin(index.keyed(single, value_key)["v0"])]
        for o, a, b in single.loc[single["first"] == _QUOTE, ["owner", "v0", "v1"]].itertuples(index=False):
            text = index.text(a, b)
            if text.lstrip()[:1] in ("[", "{"):
                again.append((o, -1, False, text))
        single = single[single["first"].isin([_BRACE, _BRACKET])]
        if not len(single):
            break
        value = pd.concat([value[~value["v0"].isin(single["box"])], single.assign(place=-1, outer=False)[_VALUE]])
    lists = value[(value["first"] == _BRACKET) & (value["place"] < 0)]
    elements = value[value["first"] == _BRACE].assign(place=lambda x: np.maximum(x["place"], 0))
    if len(lists):
        inner = _entries(index, lists[["owner", "v0"]])
        again += [(o, p, False, index.text(a, b)) for o, p, a, b in inner.loc[inner["first"] == _QUOTE, ["owner", "pos", "v0", "v1"]].itertuples(index=False)]
        inner = inner[inner["first"] == _BRACE].assign(outer=False)
        elements = pd.concat([elements, inner.assign(place=inner["pos"])[_VALUE]])
    return elements, again


def _scalars_of(index: StructuralIndex, values: pd.DataFrame) -> Iterator[tuple[int, int, str]]:
    """(owner, place, text) of the values that are neither containers nor null."""
    values = values[~values["first"].isin([_BRACE, _BRACKET])]
    for o, p, a, b in values[["owner", "place", "v0", "v1"]].itertuples(index=False):
        if index.buffer[a:b] != b"null":
            yield o, int(p), index.text(a, b)


def _children(index: StructuralIndex, value: pd.DataFrame, value_key: str, field: str | None, leaves: str | None = None) -> tuple[list, list]:
    """((owner, place, value) of the array elements, (owner, place, leaf place, leaf) of the scalars in their arrays ``leaves``).

    Re-encoded parts are indexed in rounds of their own, however often they are encoded: each is shorter than the last.
    """
    found, below = [], []
    while True:
        elements, again = _elements(index, value, value_key, field)
        if len(elements):
            members = _entries(index, elements[["owner", "place", "v0"]])
            found += _scalars_of(index, index.keyed(members, value_key))
            if leaves:
                lists = index.keyed(members, leaves)
                inner = _entries(index, lists.loc[lists["first"] == _BRACKET, ["owner", "place", "v0"]])
                at = inner["owner"].to_numpy()
                below += [(at[i], p, j, v) for i, j, v in _scalars_of(index, inner.assign(owner=np.arange(len(inner)), place=inner["pos"])) for p in [inner["place"].iat[i]]]
        if not again:
            return found, below
        owner, place, outer, texts = zip(*again)
        index = StructuralIndex(list(texts))
        value = index.roots()
        d = value["doc"].to_numpy()
        value = value.assign(owner=np.array(owner)[d], place=np.array(place)[d], outer=np.array(outer)[d])


def _rooted(texts: list[str | None], outer: bool) -> tuple[StructuralIndex, pd.DataFrame]:
    index = StructuralIndex(texts)
    return index, index.roots().assign(owner=lambda x: x["doc"], place=-1, outer=outer)


def array_children(texts: list[str | None], value_key: str, field: str | None = None) -> list[tuple[int, int, str]]:
    """(number of the text, place in the array, value) of each array element that has a value under ``value_key``.

    ``field`` names the entry of the root object that holds the array; without it the root is the array. The array
    may be wrapped in an object of one entry, a lone object is element 0, and the array or any element may be
    re-encoded as a JSON string. Null elements keep their place; missing and null values give no row.
    """
    index, value = _rooted(texts, field is not None)
    return _children(index, value, value_key, field)[0]


def object_children(texts: list[str | None], field: str, value_key: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """(entries (number of the text, key) of each text's root object, children (number of the entry, place, value) of its arrays).

    The root may be a list of objects, or re-encoded as a JSON string. ``field`` names the array in an entry's object; both
    levels are read from one index.
    """
    keys: list[tuple[int, str]] = []
    children: list[tuple[int, int, str]] = []
    owner, todo = list(range(len(texts))), list(texts)
    while todo:
        index = StructuralIndex(todo)
        roots = index.roots()
        again = [(owner[d], index.text(a, b)) for d, a, b in roots.loc[roots["first"] == _QUOTE, ["doc", "v0", "v1"]].itertuples(index=False)]
        boxes = roots[roots["first"] == _BRACKET]
        if len(boxes):
            inner = _entries(index, boxes)
            roots = pd.concat([roots, inner[inner["first"] == _BRACE][["doc", "v0", "v1", "first"]]])
        entries = _entries(index, roots.loc[roots["first"] == _BRACE, ["v0"]])
        value = entries.assign(owner=len(keys) + np.arange(len(entries)), place=-1, outer=True)
        keys += [(owner[d], index.text(a, b)) for d, a, b in entries[["doc", "k0", "k1"]].itertuples(index=False)]
        children += _children(index, value, value_key, field)[0]
        owner, todo = [o for o, _ in again], [t for _, t in again]
    return keys, children


#: So many bytes of text are indexed at once; the index takes some ten to thirty times their size in memory.
INDEX_BYTES = 1 << 21


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """(parents, texts) in portions of about INDEX_BYTES; a longer text makes a portion of its own."""
    for batch in batches:
        parents, bodies, total = [], [], 0
        for parent, body in zip(batch["parent"].astype(object), batch["body"]):
            if bodies and total + len(body) > INDEX_BYTES:
                yield parents, bodies
                parents, bodies, total = [], [], 0
            parents.append(parent)
            bodies.append(body)
            total += len(body)
        if bodies:
            yield parents, bodies


_COLUMNS = ["parent_id", "child_path", "child_pos", "child_value"]
_CHILD = "parent_id string, child_path string, child_pos bigint, child_value string"


def _mapped(frame: DataFrame, parent: str, json_text, split) -> DataFrame:
    """``split`` (parents, texts -> child rows) over all texts; one pass over the table, no shuffle. Rows without text give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for parents, bodies in _portions(batches):
            yield pd.DataFrame(split(parents, bodies), columns=_COLUMNS)

    return frame.select(F.col(parent).cast("string").alias("parent"), json_text.alias("body")).where(F.col("body").isNotNull()).mapInPandas(run, _CHILD)


def keyed_children(frame: DataFrame, parent: str, json_text: str, path: str, array_field: str, value_key: str) -> DataFrame:
    """Children of JSON objects keyed by id: the keys (``path``) and the elements of each entry's array (``path.array_field``).

    Rows whose text is null, empty or no valid JSON give nothing.
    """

    def split(parents: list, bodies: list) -> list[tuple]:
        keys, children = object_children(bodies, array_field, value_key)
        links = [f"{parents[i]}/{key}" for i, key in keys]
        return [(parents[i], path, 0, key) for i, key in keys] + [(links[i], f"{path}.{array_field}", p, v) for i, p, v in children]

    return _mapped(frame, parent, F.col(json_text), split)


def list_children(frame: DataFrame, parent: str, json_text: str, path: str, value_key: str) -> DataFrame:
    """Children of JSON arrays: one row per element with a value under ``value_key``."""

    def split(parents: list, bodies: list) -> list[tuple]:
        return [(parents[i], path, p, v) for i, p, v in array_children(bodies, value_key)]

    return _mapped(frame, parent, F.col(json_text), split)


def struct_children(frame: DataFrame, parent: str, array: str, value: str, inner: str) -> DataFrame:
    """Children of a typed array<struct>: its ``value`` per element and the elements of the array ``inner`` in it.

    The array is written as JSON and indexed like the texts. Null arrays, elements and values keep the places of the
    others. Values of ``array`` are trimmed and in lower case; rows without parent give nothing.
    """

    def split(parents: list, bodies: list) -> list[tuple]:
        index, roots = _rooted(bodies, False)
        found, below = _children(index, roots, value, None, inner)
        return [(parents[i], array, p, v.strip(" ").lower()) for i, p, v in found] + [(f"{parents[i]}/{p}", f"{array}.{inner}", j, v) for i, p, j, v in below]

    return _mapped(frame.where(F.col(parent).isNotNull()), parent, F.to_json(array), split)
