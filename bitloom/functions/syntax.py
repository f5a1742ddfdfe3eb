"""Header syntax as data: a table of elements that is read from a payload, or written.

Each element has a name, a kind, a length and a condition on an element before
it. A header of 250 elements is a long interpreted expression but a short loop,
so whole Arrow batches of headers go through one small function, which takes an
element of all rows at a time (``columnar``); what comes before and after (finding units, sets by id, slices by stream) is DataFrame
work. An element takes 64 bits at most, so ``longest`` bounds a table's bytes.

Kinds: u (n bits), v (as many bits as another element says), ue, se, one (no
bits, value 1), more (no bits, whether payload is left before the stop bit),
either (no bits, the first of some elements that is there), scale (a signed
step from the value of another element, modulo 256), skip (as many values, one
more than an element says, of as many bits as another says, which are passed
over, and written as zeros; n values at most), fail (cannot be read).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions import columnar


class Element(NamedTuple):
    name: str
    kind: str
    n: int = 0
    when: tuple[str, int, int] | None = None
    length: str = ""
    also: tuple[str, int, int] | None = None


# Ranges of elements.
RANGES = {
    "sps_id": (0, 31), "pps_id": (0, 255), "chroma_format_idc": (0, 3), "bit_depth_luma_minus8": (0, 6), "bit_depth_chroma_minus8": (0, 6), "log2_max_frame_num_minus4": (0, 12), "poc_type": (0, 2),
    "log2_max_poc_lsb_minus4": (0, 12), "num_ref_frames_in_cycle": (0, 255), "nal_cpb_cnt": (0, 31), "vcl_cpb_cnt": (0, 31), "num_slice_groups_minus1": (0, 7), "slice_group_map_type": (0, 6),
    "num_ref_l0_default_minus1": (0, 31), "num_ref_l1_default_minus1": (0, 31), "weighted_bipred_idc": (0, 2), "init_qp_minus26": (-62, 25), "init_qs_minus26": (-26, 25), "chroma_qp_offset": (-12, 12),
    "second_chroma_qp_offset": (-12, 12), "slice_type": (0, 9), "num_ref_l0_minus1": (0, 31), "num_ref_l1_minus1": (0, 31), "luma_log2_denominator": (0, 7), "chroma_log2_denominator": (0, 7),
    "slice_group_count_minus1": (0, 139_263), "cabac_init_idc": (0, 2), "deblock_idc": (0, 2), "alpha_div2": (-6, 6), "beta_div2": (-6, 6),
}
#: Bits of a slice group's number at most.
GROUP_BITS = 3
_PARSED = pa.struct([("pos", pa.int32()), ("vals", pa.map_(pa.string(), pa.int64())), ("ok", pa.bool_()), ("bad", pa.string())])


def longest(table: list[Element]) -> int:
    """Bytes that a table's elements take at most."""
    return -(-sum(64 if e.kind in ("ue", "se", "scale", "v") else e.n * GROUP_BITS if e.kind == "skip" else e.n for e in table) // 8)


def _applies(e: Element, vals: dict[str, int]) -> bool:
    for condition in (e.when, e.also):
        if condition is not None and not condition[1] <= vals.get(condition[0], condition[1] - 1) <= condition[2]:
            return False
    return True


def _golomb(bits: str, pos: int) -> tuple[int, int]:
    zeros = bits.find("1", pos) - pos
    end = pos + 2 * zeros + 1
    if not 0 <= zeros <= 32 or end > len(bits):
        raise EOFError
    return int(bits[pos + zeros : end], 2) - 1, end


def _signed(k: int) -> int:
    return (k + 1) // 2 if k % 2 else -(k // 2)


def _read(bits: str, table: list[Element], vals: dict[str, int]) -> tuple[int, bool, str | None]:
    """Adds the values of the elements present to ``vals``; the bits read, whether all could be, and which element could not."""
    pos, stop = 0, bits.rfind("1")
    for e in table:
        if e.name in vals or not _applies(e, vals):
            continue
        try:
            if e.kind in ("u", "v"):
                end = pos + (e.n if e.kind == "u" else vals[e.length])
                if end > len(bits):
                    raise EOFError
                value = int(bits[pos:end] or "0", 2)
                pos = end
            elif e.kind in ("ue", "se", "scale"):
                value, pos = _golomb(bits, pos)
                value = value if e.kind == "ue" else _signed(value)
                value = (vals[e.length] + value) % 256 if e.kind == "scale" else value
            elif e.kind == "either":
                value = next(vals[name] for name in e.length.split() if name in vals)
            elif e.kind == "skip":
                count, size = (vals[name] for name in e.length.split())
                value, pos = 1, pos + (count + 1) * size
                if pos > len(bits):
                    raise EOFError
            elif e.kind == "fail":
                raise EOFError
            else:
                value = int(stop > pos) if e.kind == "more" else e.n or 1
        except (EOFError, KeyError, StopIteration):
            return pos, False, e.name
        vals[e.name] = value
        if e.name in RANGES and not RANGES[e.name][0] <= value <= RANGES[e.name][1]:
            return pos, False, e.name
    return pos, True, None


def parse(bits: Column, table: list[Element] | dict[str, list[Element]], given: Column | None = None, key: Column | None = None) -> Column:
    """struct<pos, vals map<string,bigint>, ok, bad>: values of the elements present, of ``given`` too, whether all could be read, and which could not.

    ``bits`` are texts of 0 and 1, or bytes. With ``key`` there are several tables, and it names the one for each row;
    a row without bits, or with a key of no table, is null.
    """
    tables = table if isinstance(table, dict) else {"": table}

    @F.arrow_udf("struct<pos:int,vals:map<string,bigint>,ok:boolean,bad:string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # Given back piece by piece, as the values of a batch of long headers take much more than its bits.
        for batch in batches:
            for at in range(0, len(batch[0]), columnar.ROWS):
                rows, known, keys = (column.slice(at, columnar.ROWS) for column in batch)
                yield _by_table(tables, rows, keys, _PARSED, lambda elements, chosen: columnar.read(rows.take(chosen), elements, known.take(chosen), RANGES))

    given = F.create_map().cast("map<string,bigint>") if given is None else given
    return run(bits, given, F.lit("") if key is None else key)


def _by_table(tables: dict[str, list[Element]], rows: pa.Array, keys: pa.Array, kind: pa.DataType, made: Callable[[list[Element], pa.Array], pa.Array]) -> pa.Array:
    """What is ``made`` of each table and the places of its rows, in the order of the rows; null for those without a value or a table."""
    names = np.array(keys.to_pylist(), object)
    there = rows.is_valid().to_numpy(zero_copy_only=False)
    order, parts, done = np.full(len(rows), -1), [], 0
    for k, elements in tables.items():
        at = np.flatnonzero(there & (names == k))
        if len(at):
            parts.append(made(elements, pa.array(at)).cast(kind))
            order[at] = np.arange(done, done + len(at))
            done += len(at)
    if not parts:
        return pa.nulls(len(rows), kind)
    return parts[0] if len(parts) == 1 and done == len(rows) else pa.concat_arrays(parts).take(pa.array(order, mask=order < 0))


def scaling_lists(vals: Column) -> Column:
    """The twelve scaling lists of a set's map, in coded order: null where absent, empty where the first value is 0, else filled up with the last value."""

    @F.arrow_udf("array<array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield from (lists(rows.slice(at, columnar.ROWS)) for at in range(0, len(rows), columnar.ROWS))

    def lists(rows: pa.Array) -> pa.Array:
        known, made = columnar.given(rows), []
        for i in range(12):
            size = 16 if i < 6 else 64
            there, flag = known.columns.get(f"list_{i}", (np.zeros(len(rows), bool), None))
            there = there & (flag != 0) if flag is not None else there
            values, n, more = np.zeros((len(rows), size), np.int64), np.zeros(len(rows), np.int64), there.copy()
            for j in range(size):
                column = known.columns.get(f"list_{i}_{j}", (None, np.zeros(len(rows), np.int64)))[1]
                more = more & (column != 0)
                values[:, j] = np.where(more, column, values[:, max(j - 1, 0)])
                n += more
            whole = np.where(there & (n > 0), size, 0)
            kept = values[whole > 0].ravel()
            made.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(whole)], pa.int32()), pa.array(kept), mask=pa.array(~there)))
        # List i of row r is number i * rows + r.
        order = np.arange(12 * len(rows)).reshape(12, -1).T.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 12, pa.int32()), pa.concat_arrays(made).take(pa.array(order)))

    return run(vals)


def _put_ue(k: int) -> str:
    code = bin(k + 1)[2:]
    return "0" * (len(code) - 1) + code


def _put(table: list[Element], vals: dict[str, int]) -> str:
    # What a reader knows: values that no element has, and elements written so far.
    names = {e.name for e in table}
    known = {k: v for k, v in vals.items() if k not in names}
    out = []
    for e in table:
        if e.name in known or not _applies(e, known):
            continue
        value = e.n or 1 if e.kind == "one" else next((known[n] for n in e.length.split() if n in known), 0) if e.kind == "either" else 0
        value = known[e.name] = vals.get(e.name, value)
        n = known.get(e.length, 0) if e.kind == "v" else e.n
        if e.kind in ("u", "v"):
            out.append(bin(value)[2:].zfill(n)[-n:] if n else "")
        elif e.kind == "ue":
            out.append(_put_ue(value))
        elif e.kind in ("se", "scale"):
            step = value if e.kind == "se" else (value - known[e.length] + 128) % 256 - 128
            out.append(_put_ue(2 * step - 1 if step > 0 else -2 * step))
        elif e.kind == "skip":
            count, size = (known[name] for name in e.length.split())
            out.append("0" * ((count + 1) * size))
    return "".join(out)


def write(vals: Column, table: list[Element] | dict[str, list[Element]], key: Column | None = None) -> Column:
    """The bits of a table's elements with values from a map; the inverse of ``parse``. Elements without a value are 0.

    Marks follow from their conditions as in reading; whether the elements
    after a ``more`` are written is its value. Null without values or table.
    """
    tables = table if isinstance(table, dict) else {"": table}

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch[0]), columnar.ROWS):
                rows, keys = (column.slice(at, columnar.ROWS) for column in batch)
                yield _by_table(tables, rows, keys, pa.string(), lambda elements, chosen: columnar.write(rows.take(chosen), elements))

    return run(vals, F.lit("") if key is None else key)


def payload(vals: Column, tables: dict[str, list[Element]], key: Column, given: Column, data: Column) -> Column:
    """The bytes of what ``write`` writes, followed by the bits of ``data`` (a text, null for none), a one and zeros to a whole byte.

    ``given`` has the values, if any, that a reader of the row would be given; they go before its own.
    """

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at, n in columnar.cuts(columnar.lengths(batch[3])):
                rows, keys, known, after = (column.slice(at, n) for column in batch)
                yield _by_table(tables, rows, keys, pa.binary(), lambda elements, chosen: columnar.write(rows.take(chosen), elements, known.take(chosen), after.take(chosen)))

    return run(vals, key, given, data)


def _u(n: int, *names: str, when=None) -> list[Element]:
    return [Element(name, "u", n, when) for name in names]


def _ue(*names: str, when=None) -> list[Element]:
    return [Element(name, "ue", 0, when) for name in names]


def _se(*names: str, when=None) -> list[Element]:
    return [Element(name, "se", 0, when) for name in names]


def _hrd(kind: str) -> list[Element]:
    on = (f"{kind}_hrd", 1, 1)
    out = [*_ue(f"{kind}_cpb_cnt", when=on), *_u(4, f"{kind}_bit_rate_scale", f"{kind}_cpb_size_scale", when=on)]
    for i in range(32):
        more = (f"{kind}_cpb_cnt", i, 31)
        out += [*_ue(f"{kind}_bit_rate_{i}", f"{kind}_cpb_size_{i}", when=more), *_u(1, f"{kind}_cbr_{i}", when=more)]
    return out + _u(5, f"{kind}_initial_delay_len", f"{kind}_removal_delay_len", f"{kind}_output_delay_len", f"{kind}_time_offset_len", when=on)


# Profiles whose parameter set has the chroma fields.
CHROMA_PROFILES = (44, 83, 86, 100, 110, 118, 122, 128, 134, 138, 139, 244)
#: Offsets of a picture order cycle that are read at most; the standard allows 255.
CYCLE = 255



def _lists(present: tuple[str, int, int]) -> list[Element]:
    """Scaling lists: six of 16, then of 64, two or, where chroma is not subsampled, six; a value of 0 ends a list."""
    out = []
    for i in range(12):
        size = 16 if i < 6 else 64
        when, also = (present, None) if i < 6 else (("lists_8x8", i - 5, 6), present)
        out.append(Element(f"list_{i}", "u", 1, when, also=also))
        before = "list_start"
        for j in range(size):
            out.append(Element(f"list_{i}_{j}", "scale", when=(f"list_{i}", 1, 1) if j == 0 else (before, 1, 255), length=before))
            before = f"list_{i}_{j}"
    return [Element("list_start", "one", 8, present), *out]


VUI = [
    *_u(1, "aspect_ratio_info_present"),
    *_u(8, "aspect_ratio_idc", when=("aspect_ratio_info_present", 1, 1)),
    *_u(16, "sar_width", "sar_height", when=("aspect_ratio_idc", 255, 255)),
    *_u(1, "overscan_info_present"),
    *_u(1, "overscan_appropriate", when=("overscan_info_present", 1, 1)),
    *_u(1, "video_signal_type_present"),
    *_u(3, "video_format", when=("video_signal_type_present", 1, 1)),
    *_u(1, "video_full_range", "colour_description_present", when=("video_signal_type_present", 1, 1)),
    *_u(8, "colour_primaries", "transfer_characteristics", "matrix_coefficients", when=("colour_description_present", 1, 1)),
    *_u(1, "chroma_loc_info_present"),
    *_ue("chroma_loc_top", "chroma_loc_bottom", when=("chroma_loc_info_present", 1, 1)),
    *_u(1, "timing_info_present"),
    *_u(32, "num_units_in_tick", "time_scale", when=("timing_info_present", 1, 1)),
    *_u(1, "fixed_frame_rate", when=("timing_info_present", 1, 1)),
    *_u(1, "nal_hrd"),
    *_hrd("nal"),
    *_u(1, "vcl_hrd"),
    *_hrd("vcl"),
    Element("any_hrd", "one", when=("nal_hrd", 1, 1)),
    Element("any_hrd", "one", when=("vcl_hrd", 1, 1)),
    *_u(1, "low_delay_hrd", when=("any_hrd", 1, 1)),
    *_u(1, "pic_struct_present"),
    *_u(1, "bitstream_restriction"),
    *_u(1, "motion_vectors_over_pic_boundaries", when=("bitstream_restriction", 1, 1)),
    *_ue("max_bytes_per_pic_denom", "max_bits_per_mb_denom", "log2_max_mv_length_horizontal", "log2_max_mv_length_vertical", "max_num_reorder_frames", "max_dec_frame_buffering", when=("bitstream_restriction", 1, 1)),
]


def in_vui(elements: list[Element]) -> list[Element]:
    """Elements without a condition of their own, made to depend on vui_present."""
    return [e if e.when else e._replace(when=("vui_present", 1, 1)) for e in elements]


SPS = [
    *_u(8, "profile_idc"),
    *_u(1, *(f"constraint_set{i}" for i in range(6))),
    *_u(2, "reserved"),
    *_u(8, "level_idc"),
    *_ue("sps_id"),
    *(Element("high", "one", when=("profile_idc", p, p)) for p in CHROMA_PROFILES),
    *_ue("chroma_format_idc", when=("high", 1, 1)),
    *_u(1, "separate_colour_plane", when=("chroma_format_idc", 3, 3)),
    *_ue("bit_depth_luma_minus8", "bit_depth_chroma_minus8", when=("high", 1, 1)),
    *_u(1, "qpprime_y_zero_bypass", "scaling_matrix_present", when=("high", 1, 1)),
    Element("lists_8x8", "one", 6, ("chroma_format_idc", 3, 3)),
    Element("lists_8x8", "one", 2, ("high", 1, 1)),
    *_lists(("scaling_matrix_present", 1, 1)),
    *_ue("log2_max_frame_num_minus4", "poc_type"),
    *_ue("log2_max_poc_lsb_minus4", when=("poc_type", 0, 0)),
    *_u(1, "delta_pic_order_always_zero", when=("poc_type", 1, 1)),
    *_se("offset_for_non_ref_pic", "offset_for_top_to_bottom", when=("poc_type", 1, 1)),
    *_ue("num_ref_frames_in_cycle", when=("poc_type", 1, 1)),
    *(Element(f"offset_for_ref_frame_{i}", "se", when=("num_ref_frames_in_cycle", i + 1, CYCLE)) for i in range(CYCLE)),
    *_ue("max_num_ref_frames"),
    *_u(1, "gaps_allowed"),
    *_ue("width_mbs_minus1", "height_mbs_minus1"),
    *_u(1, "frame_mbs_only"),
    *_u(1, "mb_adaptive", when=("frame_mbs_only", 0, 0)),
    *_u(1, "direct_8x8_inference", "crop_present"),
    *_ue("crop_left", "crop_right", "crop_top", "crop_bottom", when=("crop_present", 1, 1)),
    *_u(1, "vui_present"),
    *in_vui(VUI),
]

PPS = [
    *_ue("pps_id", "sps_id"),
    *_u(1, "cabac", "bottom_field_poc"),
    *_ue("num_slice_groups_minus1"),
    *_ue("slice_group_map_type", when=("num_slice_groups_minus1", 1, 7)),
    *(Element(f"run_length_minus1_{i}", "ue", when=("slice_group_map_type", 0, 0), also=("num_slice_groups_minus1", i, 7)) for i in range(8)),
    *(Element(f"{name}_{i}", "ue", when=("slice_group_map_type", 2, 2), also=("num_slice_groups_minus1", i + 1, 7)) for i in range(7) for name in ("top_left", "bottom_right")),
    *_u(1, "slice_group_change_direction", when=("slice_group_map_type", 3, 5)),
    *_ue("slice_group_change_rate_minus1", when=("slice_group_map_type", 3, 5)),
    *_ue("slice_group_count_minus1", when=("slice_group_map_type", 6, 6)),
    *(Element("slice_group_bits", "one", bits, ("num_slice_groups_minus1", low, high), also=("slice_group_map_type", 6, 6)) for bits, low, high in ((1, 1, 1), (2, 2, 3), (3, 4, 7))),
    Element("slice_group_ids", "skip", 139_264, ("slice_group_map_type", 6, 6), "slice_group_count_minus1 slice_group_bits"),
    *_ue("num_ref_l0_default_minus1", "num_ref_l1_default_minus1"),
    *_u(1, "weighted_pred"),
    *_u(2, "weighted_bipred_idc"),
    *_se("init_qp_minus26", "init_qs_minus26", "chroma_qp_offset"),
    *_u(1, "deblock_control", "constrained_intra", "redundant_pic_cnt_present"),
    Element("more", "more"),
    *_u(1, "transform_8x8", "pic_scaling_matrix_present", when=("more", 1, 1)),
    Element("lists_8x8", "one", 2, ("transform_8x8", 1, 1)),
    *_lists(("pic_scaling_matrix_present", 1, 1)),
    *_se("second_chroma_qp_offset", when=("more", 1, 1)),
]

#: Reference entries that a header may reorder or weigh, and marking commands read, at most.
ENTRIES = 32


def _modifications(list_no: int, when: tuple[str, int, int]) -> list[Element]:
    name = f"l{list_no}"
    out = [*_u(1, f"{name}_modified", when=when), Element(f"{name}_go_0", "one", when=(f"{name}_modified", 1, 1))]
    for i in range(ENTRIES + 1):
        out += [
            *_ue(f"{name}_op_{i}", when=(f"{name}_go_{i}", 1, 1)),
            *_ue(f"{name}_v_{i}", when=(f"{name}_op_{i}", 0, 2)),
            Element(f"{name}_go_{i + 1}", "one", when=(f"{name}_op_{i}", 0, 2)),
        ]
    return [*out, Element(f"{name}_too_many", "fail", when=(f"{name}_go_{ENTRIES + 1}", 1, 1))]


def _weights(list_no: int, on: str) -> list[Element]:
    """Weights of a list's entries, whose number less one is the element n_l0 or n_l1; ``on`` is a mark that there are weights."""
    out = []
    for i in range(ENTRIES):
        name = f"l{list_no}_{i}"
        out += [
            Element(f"w{name}", "one", when=(f"{on}{list_no}", i, ENTRIES)),
            *_u(1, f"luma_weight_{name}_flag", when=(f"w{name}", 1, 1)),
            *_se(f"luma_weight_{name}", f"luma_offset_{name}", when=(f"luma_weight_{name}_flag", 1, 1)),
            *_u(1, f"chroma_weight_{name}_flag", when=(f"w{name}", 1, 1)),
            *_se(*(f"{plane}_{x}_{name}" for plane in ("cb", "cr") for x in ("weight", "offset")), when=(f"chroma_weight_{name}_flag", 1, 1)),
        ]
    return out


def _marking() -> list[Element]:
    out = [*_u(1, "adaptive_marking", when=("marks_refs", 1, 1)), Element("mmco_go_0", "one", when=("adaptive_marking", 1, 1))]
    for i in range(ENTRIES):
        op = f"mmco_{i}"
        out += [*_ue(op, when=(f"mmco_go_{i}", 1, 1)), *_ue(f"mmco_diff_{i}", when=(op, 1, 1)), *_ue(f"mmco_diff_{i}", when=(op, 3, 3))]
        out += [*_ue(f"mmco_long_{i}", when=(op, 2, 2)), *_ue(f"mmco_long_{i}", when=(op, 3, 4)), *_ue(f"mmco_long_{i}", when=(op, 6, 6)), Element(f"mmco_go_{i + 1}", "one", when=(op, 1, 6))]
    return [*out, Element("mmco_too_many", "fail", when=(f"mmco_go_{ENTRIES}", 1, 1))]


SLICE_START = _ue("first_mb", "slice_type", "pps_id")

#: A slice header up to its reference counts; ``given`` has the parameter sets' values and nal_unit_type.
SLICE = [
    *SLICE_START,
    *(Element("is_p", "one", when=("slice_type", t, t)) for t in (0, 5)),
    *(Element("is_b", "one", when=("slice_type", t, t)) for t in (1, 6)),
    Element("is_inter", "one", when=("is_p", 1, 1)),
    Element("is_inter", "one", when=("is_b", 1, 1)),
    Element("frame_num", "v", length="log2_max_frame_num"),
    *_ue("idr_pic_id", when=("nal_unit_type", 5, 5)),
    Element("poc_lsb", "v", when=("poc_type", 0, 0), length="log2_max_poc_lsb"),
    *_se("delta_poc_bottom", when=("reads_bottom", 1, 1)),
    *_se("delta_poc_0", when=("reads_delta_0", 1, 1)),
    *_se("delta_poc_1", when=("reads_delta_1", 1, 1)),
    *_ue("redundant_pic_cnt", when=("redundant_pic_cnt_present", 1, 1)),
    *_u(1, "direct_spatial", when=("is_b", 1, 1)),
    *_u(1, "override", when=("is_inter", 1, 1)),
    *_ue("num_ref_l0_minus1", when=("override", 1, 1)),
]


def slice_table(kind: str, weighted: bool) -> list[Element]:
    """The header of I, P or B slices, with or without a table of explicit weights.

    ``given`` needs marks that depend on the parameter sets (marks_refs,
    reads_bottom and the like). The numbers of active references less one are
    the slice's own, else those of the picture parameter set, default_l0 and
    default_l1; weighs_l0 and weighs_l1 in ``given`` go before both.
    """
    out = [*SLICE]
    if kind == "B":
        out += _ue("num_ref_l1_minus1", when=("override", 1, 1))
    if kind in "PB":
        out += _modifications(0, ("is_inter", 1, 1))
    if kind == "B":
        out += _modifications(1, ("is_b", 1, 1))
    if weighted and kind in "PB":
        out += [Element(f"weighs_l{i}", "either", length=f"num_ref_l{i}_minus1 default_l{i}") for i in range(1 + (kind == "B"))]
        out += [*_ue("luma_log2_denominator", "chroma_log2_denominator"), *_weights(0, "weighs_l")]
        if kind == "B":
            out += _weights(1, "weighs_l")
    out += [*_u(1, "no_output_of_prior", "long_term_reference", when=("nal_unit_type", 5, 5)), *_marking()]
    if kind in "PB":
        out += _ue("cabac_init_idc", when=("cabac", 1, 1))
    out += [*_se("qp_delta"), *_ue("deblock_idc", when=("deblock_control", 1, 1)), Element("deblocks", "one", when=("deblock_idc", 0, 0)), Element("deblocks", "one", when=("deblock_idc", 2, 2))]
    return out + _se("alpha_div2", "beta_div2", when=("deblocks", 1, 1))


#: Headers by kind of slice, with "w" where there are explicit weights.
SLICE_TABLES = {f"{kind}{'w' * weighted}": slice_table(kind, weighted) for kind, weighted in (("I", False), ("P", False), ("P", True), ("B", False), ("B", True))}
