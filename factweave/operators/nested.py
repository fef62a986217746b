"""Deeply nested JSON attributes to flat tables, level by level over Arrow buffers.

One batch of texts is handled as one byte buffer with row offsets. Structural characters, strings and scalars are
found by array operations over the whole buffer; every token learns its container by one stable sort on
(row, depth); then each level of value objects is emitted at once: parents are indices, and keys and paths come
down by ``take``. No row is parsed on its own, and depth costs only one more round per level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WS, OBJ, OBJ_END, ARR, ARR_END, COLON, COMMA, STR, SCALAR = range(9)
_CLASS = np.full(256, SCALAR, np.uint8)
for _chars, _c in ((" \t\n\r", WS), ("{", OBJ), ("}", OBJ_END), ("[", ARR), ("]", ARR_END), (":", COLON), (",", COMMA), ('"', WS)):
    for _x in _chars:
        _CLASS[ord(_x)] = _c
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[[ord(x) for x in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(x) for x in "0123456789abcdefABCDEF"]] = True
_SCALAR_TEXT = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


@dataclass
class Tokens:
    """The tokens of one batch in order of place; indices are into these arrays, -1 stands for none."""

    buf: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    container: np.ndarray
    key: np.ndarray
    position: np.ndarray
    root: np.ndarray
    valid: np.ndarray


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one entry more than texts); a null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A string array of buf[start:end] for each pair."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    places = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    data = buf[places] if len(places) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _equals(buf: np.ndarray, start: np.ndarray, end: np.ndarray, word: bytes) -> np.ndarray:
    at = np.flatnonzero(end - start == len(word))
    for j, x in enumerate(word):
        at = at[buf[start[at] + j] == x]
    out = np.zeros(len(start), bool)
    out[at] = True
    return out


def tokenize(texts: pa.Array) -> Tokens:
    """All tokens of the texts, with `valid` telling which texts are one complete JSON value."""
    buf, offsets = _buffer(texts)
    n, rows = len(buf), len(offsets) - 1
    valid = offsets[1:] > offsets[:-1]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    row_of = lambda at: np.searchsorted(offsets, at, "right") - 1

    # what a backslash escapes: every second one of a run escapes the byte after it
    slash = np.flatnonzero(buf == 92)
    escaping = slash
    quotes = np.flatnonzero(buf == 34)
    if len(slash):
        first = np.ones(len(slash), bool)
        first[1:] = (np.diff(slash) != 1) | begins[slash[1:]]
        run = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
        escaping = slash[(np.arange(len(slash)) - run) % 2 == 0]
        hit = np.zeros(n + 1, bool)
        hit[escaping + 1] = True
        hit[offsets] = False
        quotes = quotes[~hit[quotes]]
    quote_row = row_of(quotes)
    odd = np.bincount(quote_row, minlength=rows) % 2 == 1
    valid &= ~odd
    quotes = quotes[~odd[quote_row]]

    toggle = np.zeros(n + 1, np.int8)
    toggle[quotes[0::2]] = 1
    toggle[quotes[1::2]] = -1
    inside = np.cumsum(toggle[:-1], dtype=np.int8).view(bool)  # from the opening quote up to the byte before the closing one
    cls = _CLASS[buf]
    cls[inside] = WS
    cls[quotes[0::2]] = STR
    cls[quotes[1::2]] = WS
    bad = np.flatnonzero(inside & (buf < 32))
    valid[row_of(bad)] = False
    if len(escaping):
        after = np.minimum(escaping + 1, n - 1)
        wrong = ~inside[escaping] | ~_ESCAPABLE[buf[after]] | begins[escaping + 1]
        valid[row_of(escaping[wrong])] = False
        wide = escaping[buf[after] == ord("u")]
        for j in range(2, 6):
            at = np.minimum(wide + j, n - 1)
            valid[row_of(wide[~_HEX[buf[at]] | ~inside[at]])] = False

    scalar = cls == SCALAR
    before = np.zeros(n, bool)
    before[1:] = scalar[:-1]
    before[begins[:-1]] = False
    keep = (cls != WS) & ~(scalar & before)
    start = np.flatnonzero(keep)
    kind = cls[start]
    row = row_of(start)
    end = start + 1
    is_scalar = kind == SCALAR
    if is_scalar.any():
        stop = np.zeros(n + 1, bool)
        stop[1:] = scalar
        stop[:-1] &= ~scalar | begins[:-1]
        stop[n] = n > 0 and scalar[-1]
        end[is_scalar] = np.flatnonzero(stop)[: int(is_scalar.sum())]
        words = _slices(buf, start[is_scalar], end[is_scalar]).dictionary_encode()
        wrong = np.array([not _SCALAR_TEXT.fullmatch(x) for x in words.dictionary.to_pylist()], bool)
        valid[row[is_scalar][wrong[words.indices.to_numpy()]]] = False
    end[kind == STR] = quotes[1::2] + 1

    # depth of the container each token lies in; brackets lie in the outer one
    step = np.where((kind == OBJ) | (kind == ARR), 1, np.where((kind == OBJ_END) | (kind == ARR_END), -1, 0))
    total = np.concatenate([[0], np.cumsum(step)])
    first_of = np.searchsorted(row, np.arange(rows + 1))
    valid &= total[first_of[1:]] == total[first_of[:-1]]
    depth_after = total[1:] - total[first_of[row]]
    valid[row[depth_after < 0]] = False
    depth = depth_after - (step > 0)

    live = np.flatnonzero(valid[row])
    opens = live[step[live] > 0]
    level = np.concatenate([depth[opens] + 1, depth[live] + (step[live] < 0)])
    token = np.concatenate([opens, live])
    is_open = np.concatenate([np.ones(len(opens), bool), np.zeros(len(live), bool)])
    # an opening bracket stands for its container before the tokens inside it, since those come later
    order = np.argsort((row[token] * (int(level.max(initial=0)) + 1) + level) * (2 * len(start) + 2) + 2 * token + ~is_open, kind="stable")
    token, level, is_open = token[order], level[order], is_open[order]
    last_open = np.maximum.accumulate(np.where(is_open, np.arange(len(token)), -1))
    inner = ~is_open
    container = np.full(len(start), -1)
    container[token[inner]] = np.where(level[inner] > 0, token[np.maximum(last_open[inner], 0)], -1)
    commas = np.cumsum(~is_open & (kind[token] == COMMA))
    position = np.zeros(len(start), np.int64)
    position[token[inner]] = commas[inner] - commas[np.maximum(last_open[inner], 0)]
    closer = (kind == OBJ_END) | (kind == ARR_END)
    opener = np.where(closer, container, -1)

    holder = np.where(container >= 0, kind[container], WS)
    prev = np.concatenate([[WS], kind[:-1]]).astype(np.uint8) if len(kind) else kind
    head = np.zeros(len(kind), bool)
    head[first_of[:-1][first_of[:-1] < first_of[1:]]] = True
    prev[head] = WS
    is_key = (kind == STR) & (holder == OBJ) & ((prev == OBJ) | (prev == COMMA))
    prev_key = np.concatenate([[False], is_key[:-1]]) if len(kind) else is_key
    value_end = ((prev == STR) & ~prev_key) | (prev == SCALAR) | (prev == OBJ_END) | (prev == ARR_END)
    value = ((kind == STR) & ~is_key) | (kind == SCALAR) | (kind == OBJ) | (kind == ARR)
    good = np.where(value, head | ((holder == OBJ) & (prev == COLON)) | ((holder == ARR) & ((prev == ARR) | (prev == COMMA))), True)
    good &= np.where(kind == COLON, prev_key, True)
    good &= np.where(kind == COMMA, (holder != WS) & value_end, True)
    good &= np.where(closer, (kind == holder + 1) & (value_end | (prev == holder)), True)
    valid[row[~good]] = False
    valid &= np.bincount(row[value & (container < 0)], minlength=rows) == 1

    end[opener[closer & (opener >= 0)]] = start[closer & (opener >= 0)] + 1
    key = np.full(len(kind), -1)
    owned = np.flatnonzero(value & (holder == OBJ) & (prev == COLON))
    key[owned] = owned - 2
    # of a key that an object has more than once the last holds
    root = np.full(rows, -1)
    top = np.flatnonzero(value & (container < 0) & valid[row])
    root[row[top]] = top
    return Tokens(buf, kind, start, end, row, container, key, position, root, valid)


def _texts(t: Tokens, at: np.ndarray) -> pa.Array:
    """The text of each token: a string's content, anything else as written; null for none and for `null`."""
    have = at >= 0
    tok = np.maximum(at, 0)
    quoted = (t.kind[tok] == STR) & have if len(t.kind) else have
    start = np.where(have, t.start[tok] + quoted, 0) if len(t.kind) else np.zeros(len(at), np.int64)
    end = np.where(have, t.end[tok] - quoted, 0) if len(t.kind) else np.zeros(len(at), np.int64)
    out = _slices(t.buf, start, end)
    slashed = np.flatnonzero(pc.match_substring(out, "\\").to_numpy(zero_copy_only=False) & quoted)
    if len(slashed):
        raw = out.take(pa.array(slashed)).dictionary_encode()
        plain = pa.array([_plain(x) for x in raw.dictionary.to_pylist()], pa.large_string()).take(raw.indices)
        mask = np.zeros(len(out), bool)
        mask[slashed] = True
        out = pc.replace_with_mask(out, pa.array(mask), plain)
    nothing = ~have
    if len(t.kind):
        bare = np.flatnonzero(have & (t.kind[tok] == SCALAR))
        nothing[bare[_equals(t.buf, t.start[tok[bare]], t.end[tok[bare]], b"null")]] = True
    return pc.if_else(pa.array(nothing), pa.scalar(None, pa.large_string()), out)


def _plain(x: str) -> str:
    text = json.loads(f'"{x}"')
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # half of a pair can't be stored


def _keyed(t: Tokens, word: str, live: np.ndarray) -> np.ndarray:
    """The values whose key is the word; of a key written twice in one object the last."""
    key = t.key[live]
    hit = _equals(t.buf, t.start[key] + 1, t.end[key] - 1, word.encode())
    return live[hit]


def value_objects(texts: pa.Array, keep: list[pa.Array], fields: bool) -> tuple[list[pa.Array], dict[str, pa.Array]]:
    """All value objects of the texts, level by level. `keep`: columns that are carried down by take."""
    t = tokenize(texts)
    inner = np.flatnonzero((t.root >= 0) & (t.kind[np.maximum(t.root, 0)] == STR)) if len(t.kind) else np.zeros(0, np.int64)
    n = len(t.kind)
    live = np.flatnonzero((t.key >= 0) & t.valid[t.row]) if n else np.zeros(0, np.int64)
    if len(live):
        escaped = np.zeros(len(t.buf) + 1, np.int64)
        np.cumsum(t.buf == 92, out=escaped[1:])
        key = t.key[live]
        odd = escaped[t.end[key]] > escaped[t.start[key]]
        names = _slices(t.buf, t.start[key] + 1, t.end[key] - 1).dictionary_encode()
        codes = names.indices.to_numpy().astype(np.int64)
        words = names.dictionary.to_pylist()
        if odd.any():
            plain = {}
            words = [_plain(x) if "\\" in x else x for x in words]
            codes = np.array([plain.setdefault(x, len(plain)) for x in words])[codes]
            words = list(plain)
        pair = t.container[live] * np.int64(len(words) + 1) + codes
        if len(order := np.argsort(pair, kind="stable")):
            last = np.ones(len(order), bool)
            last[:-1] = pair[order[:-1]] != pair[order[1:]]
            chosen = np.sort(order[last])
            live, codes = live[chosen], codes[chosen]
    else:
        words, codes = [], np.zeros(0, np.int64)
    dictionary = pa.array(words, pa.large_string())
    code_of = np.full(n, -1)
    code_of[live] = codes
    index = {w: i for i, w in enumerate(words)}
    is_named = lambda at, w: code_of[at] == index.get(w, -2)

    has_kind = np.zeros(n, bool)
    has_kind[t.container[live[is_named(live, "kind")]]] = True
    objects = np.flatnonzero((t.kind == OBJ) & has_kind & t.valid[t.row]) if n else np.zeros(0, np.int64)
    cont = t.container[objects]
    objects, cont = objects[cont >= 0], cont[cont >= 0]
    in_array = t.kind[cont] == ARR
    objects, cont, in_array = (x[in_array | (code_of[objects] >= 0)] for x in (objects, cont, in_array))
    up = t.container[cont]
    owner = np.full(len(objects), -1)
    items = in_array & is_named(cont, "items") & (up >= 0)
    owner[items] = up[items]
    named = ~in_array & is_named(cont, "parameters") & (up >= 0)
    upper = np.maximum(up, 0)
    named &= is_named(upper, "annotation")
    owner[named] = t.container[up[named]]
    top = ~in_array & (up < 0)

    slot = np.full(n, -1)  # where an emitted value object stands in its level
    frontier = objects[top]
    path = dictionary.take(pa.array(code_of[frontier])) if len(words) else pa.array([], pa.large_string())
    parent = pa.array([""] * len(frontier), pa.large_string())
    rest = np.flatnonzero(owner >= 0)
    levels: list[tuple[np.ndarray, pa.Array, pa.Array]] = []
    while len(frontier):
        levels.append((frontier, path, parent))
        slot[frontier] = np.arange(len(frontier))
        now = slot[owner[rest]] >= 0
        at, rest = rest[now], rest[~now]
        parent = path.take(pa.array(slot[owner[at]]))
        slot[frontier] = -1
        by_index = in_array[at]
        numbers = pc.cast(pa.array(t.position[objects[at]]), pa.large_string())
        element = pc.binary_join_element_wise(pa.scalar("[", pa.large_string()), numbers, pa.scalar("]", pa.large_string()), pa.scalar("", pa.large_string()))
        name = dictionary.take(pa.array(np.maximum(code_of[objects[at]], 0)))
        member = pc.binary_join_element_wise(pa.scalar(".", pa.large_string()), name, pa.scalar("", pa.large_string()))
        path = pc.binary_join_element_wise(parent, pc.if_else(pa.array(by_index), element, member), pa.scalar("", pa.large_string()))
        frontier = objects[at]

    found = np.concatenate([x[0] for x in levels]) if levels else np.zeros(0, np.int64)
    out = {
        "path": pa.chunked_array([x[1] for x in levels], pa.large_string()).combine_chunks(),
        "parent_path": pa.chunked_array([x[2] for x in levels], pa.large_string()).combine_chunks(),
    }
    rows = t.row[found] if n else found
    kept = [k.take(pa.array(rows)) for k in keep]
    if fields:
        for column, word in (("kind", "kind"), ("value", "value"), ("enum_type", "enumType")):
            out[column] = _texts(t, _child(t, live[is_named(live, word)], found, n))
        inner_ann = _child(t, live[is_named(live, "annotation")], found, n)
        out["annotation_type"] = _texts(t, np.where(inner_ann >= 0, _child(t, live[is_named(live, "type")], np.maximum(inner_ann, 0), n), -1))
        out["item_count"] = pa.array(_lengths(t, _child(t, live[is_named(live, "items")], found, n)), pa.int64())
    if len(inner):
        decoded = _texts(t, t.root[inner])
        again = pc.if_else(pc.starts_with(pc.utf8_ltrim(decoded, characters=" \t\r\n"), "{"), decoded, pa.scalar("", pa.large_string()))
        more_kept, more = value_objects(again, [k.take(pa.array(inner)) for k in keep], fields)
        kept = [pa.concat_arrays([a, b]) for a, b in zip(kept, more_kept, strict=True)]
        out = {k: pa.concat_arrays([v, more[k]]) for k, v in out.items()}
    return kept, out


def _child(t: Tokens, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    at = np.full(max(n, 1), -1)
    at[t.container[values]] = values
    return at[of]


def _lengths(t: Tokens, arrays: np.ndarray) -> np.ma.MaskedArray:
    """Elements of each array token; masked where there is none."""
    n = len(t.kind)
    is_array = np.zeros(len(arrays), bool)
    if n:
        is_array = (arrays >= 0) & (t.kind[np.maximum(arrays, 0)] == ARR)
    value = (t.kind != COMMA) & (t.kind != COLON) & (t.kind != OBJ_END) & (t.kind != ARR_END) & (t.container >= 0)
    size = np.bincount(t.container[value], minlength=max(n, 1))
    return np.ma.masked_array(size[np.maximum(arrays, 0)], ~is_array)


def complete(texts: pa.Array) -> np.ndarray:
    """Which texts are one whole JSON object, or a JSON string that holds one."""
    t = tokenize(texts)
    out = np.zeros(len(texts), bool)
    if len(t.kind):
        have = np.flatnonzero(t.root >= 0)
        kinds = t.kind[t.root[have]]
        out[have[kinds == OBJ]] = True
        quoted = have[kinds == STR]
        if len(quoted):
            inner = tokenize(_texts(t, t.root[quoted]))
            if len(inner.kind):
                out[quoted] = (inner.root >= 0) & (inner.kind[np.maximum(inner.root, 0)] == OBJ)
    return out


def _one_text_per_site(sites: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Deliveries of one site are copies; a complete one wins over a broken one. Partial aggregation leaves one
    text of a site per task, so a site that is delivered ever so often doesn't weigh on one task."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _by_bytes(batch):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(complete(piece.column(1)))], names=["id", "text", "whole"])

    rows = sites.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{json_col}`").alias("text")).where("id is not null and text is not null")
    rows = rows.mapInArrow(scored, f"id {dict(sites.dtypes)[id_col]}, text string, whole boolean")
    return rows.groupBy("id").agg(F.max_by("text", F.struct("whole", F.xxhash64("text"), F.length("text"))).alias("text")).select(F.col("id").alias(id_col), F.col("text").alias(json_col))


def flatten_values(sites: DataFrame, id_col: str = "site_id", json_col: str = "attrs", fields: bool = True) -> DataFrame:
    """One row for each value object of each site: id, path, parent_path and, with `fields`, kind, value,
    enum_type, annotation_type (of the nested annotation) and item_count (nulls counted).

    Rows without id or text, and text that isn't one complete JSON object (or a JSON string holding one), give no
    rows. Copies of a site count once; of a key written twice in one object the last holds. `{}` gives no rows.
    """
    id_type = dict(sites.dtypes)[id_col]
    columns = {"path": "string", "parent_path": "string"}
    if fields:
        columns |= {"kind": "string", "value": "string", "enum_type": "string", "annotation_type": "string", "item_count": "bigint"}

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _by_bytes(batch):
                (ids,), out = value_objects(piece.column(1), [piece.column(0)], fields)
                if len(ids):
                    arrays = [ids] + [x.cast(pa.string()) if pa.types.is_large_string(x.type) else x for x in out.values()]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *out])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{k} {v}" for k, v in columns.items())
    return _one_text_per_site(sites, id_col, json_col).mapInArrow(flatten, schema)


def _by_bytes(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, so that the arrays over them stay in cache and memory."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
    group = np.cumsum(size) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(size)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def flatten_sites(sites: DataFrame, id_col: str = "site_id", json_col: str = "attrs") -> dict[str, DataFrame]:
    """Related flat tables: `sites` (one row per id, without the JSON), `annotations` (one row per nested
    annotation: id, path of the value object holding it, its type, its parent_path) and `values`.

    Every annotation and value names its parent by (id, parent_path), '' being the site itself.
    """
    values = flatten_values(sites, id_col, json_col)
    plain = sites.where(F.col(id_col).isNotNull()).drop(json_col)
    others = [c for c in plain.columns if c != id_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(1)
    head = plain.groupBy(id_col).agg(F.max(row).alias("_row"))
    head = head.select(id_col, *[F.col("_row").getField(c).alias(c) for c in others])
    annotations = values.where("annotation_type is not null").select(id_col, "path", "parent_path", "annotation_type")
    return {"sites": head, "annotations": annotations, "values": values}
