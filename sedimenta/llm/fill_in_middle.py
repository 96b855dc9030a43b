"""Fill-in-the-middle transformation (operator 11): in-place block rotation.

A text is cut into prefix, middle and suffix at two scanned places. The three sentinels go into the text's byte array in
front of their blocks, and blocks change places by three reversals (of each block, then of both together), so nothing
but that one array is held. The inverse finds the sentinels and rotates back, which gives the text exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import in_columns, slices, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM_RATE = 42, 50, 80


def unit_ends(text: np.ndarray) -> np.ndarray:
    """Byte places where the units of a text end: a word with the white space before it, or white space at the end."""
    blank = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    return np.r_[ends, len(text)] if len(text) and blank[-1] else ends


def _reversed(view: np.ndarray, start: int, end: int) -> None:
    half = (end - start) // 2
    left = view[start:start + half].copy()
    view[start:start + half] = view[end - half:end][::-1]
    view[end - half:end] = left[::-1]


def rotate(held: bytearray, start: int, cut: int, end: int) -> None:
    """Let the neighbouring blocks start:cut and cut:end change places."""
    with memoryview(held) as memory:
        view = np.frombuffer(memory, np.uint8)
        _reversed(view, start, cut)
        _reversed(view, cut, end)
        _reversed(view, start, end)
        del view


def transformed(text: bytes, first: int, second: int, form: str) -> bytes:
    """The text cut at two byte places, in the order of ``form`` (psm or spm)."""
    held = bytearray(text)
    for place, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        held[place:place] = mark
    # now: prefix, middle, suffix, each behind its sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(held, middle if form == "psm" else 0, suffix, len(held))
    return bytes(held)


def restored(output: bytes, form: str) -> bytes:
    """The text that ``transformed`` was given. No sentinel overlaps another or itself, so each stands where it was put."""
    if form == "plain":
        return output
    held, middle = bytearray(output), output.find(MIDDLE)
    if form == "psm":
        suffix = output.find(SUFFIX)
        rotate(held, suffix, middle, len(held))
        first, second = suffix, suffix + len(held) - middle
    else:
        prefix = output.find(PREFIX)
        rotate(held, 0, prefix, len(held))
        first, second = middle - prefix, len(held) - prefix
    for place, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        del held[place:place + len(mark)]
    return bytes(held)


def _chars(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per document: (id, n, form, prefix_chars, middle_chars, output).

    ``n`` counts a text's units (a word with the white space before it; white space at the end). Four numbers from the
    SHA-256 of ``seed:id`` place the two cuts and choose the form: plain (the text itself) in ``100 - rate`` of a hundred,
    else spm in ``spm_rate`` of a hundred and psm in the rest. Texts that are empty, null (as empty) or hold a sentinel
    are plain; plain rows have null lengths. Texts are worked on whole, one at a time. Repeated rows stay, a null id
    is hashed as an empty one; an empty table gives an empty result; other columns are ignored.
    """
    def columns(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            rows = []
            for i, key, text in zip(batch.column(0), batch.column(2).to_pylist(), batch.column(1)):
                data = text.as_buffer()
                data = b"" if data is None else data.to_pybytes()
                view = np.frombuffer(data, np.uint8)
                ends, digest = unit_ends(view), hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
                n = len(ends)
                h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
                if not data or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
                    rows.append((i, n, "plain", None, None, data))
                    continue
                first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                form = "spm" if h4 % 100 < spm_rate else "psm"
                rows.append((i, n, form, _chars(view[:first]), _chars(view[first:second]), transformed(data, first, second, form)))
            i, *rest, output = zip(*rows)
            yield [pa.array([x.as_py() for x in i], batch.schema.field(0).type), *rest, pa.array(output, pa.binary()).view(pa.string())]

    kind = dict(docs.dtypes)[id_col]
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"))
    return in_columns(chosen, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string", columns)


def with_restored(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The rows of ``fill_in_middle`` with the text that ``restored`` makes of output and form alone (column ``restored``)."""
    columns_ = [c for c in outputs.columns if c != "restored"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.select(columns_).schema)
    at, form_at = columns_.index(output_col), columns_.index(form_col)

    def columns(batches):
        for batch in (part for b in batches for part in slices(b, at)):
            forms, texts = batch.column(form_at).to_pylist(), batch.column(at).cast(pa.binary()).to_pylist()
            back = pa.array([restored(t, f) for t, f in zip(texts, forms)], pa.binary()).view(pa.string())
            yield [*batch.columns, back]

    return in_columns(outputs.select(columns_), f"{kind}, restored string", columns)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    done = with_restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    sha256('42:' || coalesce(doc_id::varchar, '')) as digest
  from documents
), numbers as (
  select *, len(units) as n,
    ('0x' || digest[1:8])::bigint as h1, ('0x' || digest[9:16])::bigint as h2,
    ('0x' || digest[17:24])::bigint as h3, ('0x' || digest[25:32])::bigint as h4
  from cut
), chosen as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as first, greatest(h1 % (n + 1), h2 % (n + 1)) as second,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from numbers
), blocks as (
  select *, array_to_string(units[1:first], '') as prefix, array_to_string(units[first + 1:second], '') as middle,
    array_to_string(units[second + 1:n], '') as suffix
  from chosen
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
  case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from blocks
"""
