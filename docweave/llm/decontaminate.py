"""Benchmark decontamination by template canonicalisation.

Words are put in a canonical form: lower case without punctuation; numbers become <num>, a unit behind a number
<unit>, a capitalised word inside a sentence <name>. An item has up to three forms: its canonical words (`template`); the same with names
as plain words, as in a copy without capitals or in capitals only (`lower`); and its plain words (`words`), if it is too short for a window of
`k` words or too many of its windows are placeholders only. Items that share a form, slot for slot, are one template: documents are
compared with templates, not with items, so many items of one template cost as much as one.

A document is contaminated by a template if it holds a share of `cover` or more of the form's windows and its slots are consistent: each value in a slot of the
item stands for one value in the document, but for a share of 1 - `cover` of the slots. So a copy with new
numbers or names is caught as well as a copy word for word.

Plan. A bitmap of the templates' windows, of bounded size whatever their number, goes to the tasks that read documents, which keep the
windows that may be among them; a hash join drops the rest. Of every template only as many of its rarest windows as a document
cannot lack all at once are joined with the documents; the pairs found so are then counted in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.session import release, spool
from docweave.llm.blocks import buffer_of, mixed
from docweave.llm.near_dup import chunks
from docweave.llm.window_dedup import BASES, rolling, word_hashes, words_in

#: Units of measure that count behind a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year "
    "meters meter metres metre kilometers kilometer miles mile feet inches grams gram kilograms kilogram pounds pound liters liter litres litre dollars dollar euros euro cents cent percent usd eur gbp "
    "hz khz mhz ghz kb mb gb tb w kw v a k c f"
).split()
NUM, UNIT, NAME = (np.uint64(0x1F3D5B79 + 0x9E3779B97F4A7C15 * i % 2**63) for i in (1, 2, 3))
#: The bitmap has 2 ** n bits, 64 a window within these bounds (8 KB to 16 MB).
LEAST_BITS, MOST_BITS = 16, 27
FORMS = ("template", "lower", "words")

KEEP = np.zeros(256, bool)
KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?:\"'»”)"])
#: Letters of all scripts with two cases: capitals, small letters, and the small letter of a capital that takes as many bytes.
POINTS = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(1 << 16)]
UPPER, SMALL = np.array([c.isupper() for c in POINTS]), np.array([c.islower() for c in POINTS])
FOLD = np.array([ord(c.lower()) if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else ord(c) for c in POINTS]).astype(np.uint16)
FOLD[0xD800:0xE000] = np.arange(0xD800, 0xE000)


def cased(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes in lower case, and where capitals and small letters begin."""
    folded, upper, small = text.copy(), (text >= 65) & (text <= 90), (text >= 97) & (text <= 122)
    folded[upper] += 32
    for width, least, most in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF)):
        at = np.flatnonzero((text >= least) & (text <= most))
        at = at[at + width <= len(text)]
        point = (text[at] & (0x1F if width == 2 else 0x0F)).astype(np.int64)
        for i in range(1, width):
            point = (point << 6) | (text[at + i] & 0x3F)
        upper[at], small[at] = UPPER[point], SMALL[point]
        low = FOLD[point]
        for i in range(1, width):
            folded[at + i] = 0x80 | ((low >> (6 * (width - 1 - i))) & 0x3F)
        folded[at] = (0xC0 if width == 2 else 0xE0) | (low >> (6 * (width - 1)))
    return folded, upper, small


class Words:
    """The words of some texts: canonical and plain hashes, which are slots and which of these names, a hash of each as written, first word of each text."""

    def __init__(self, texts: pa.ChunkedArray):
        buf, offsets = buffer_of(texts)
        starts, ends = words_in(buf, offsets)
        # words of punctuation only are left out
        kept = np.flatnonzero(KEEP[buf])
        before = np.concatenate([[0], np.cumsum(KEEP[buf])])
        some = before[ends] > before[starts]
        starts, ends = starts[some], ends[some]
        self.heads = np.searchsorted(starts, offsets)
        if not len(starts):
            self.canon = self.plain = self.value = np.zeros(0, np.uint64)
            self.slot = self.name = np.zeros(0, bool)
            return
        first, stop = before[starts], before[ends]
        folded, upper, small = cased(buf[kept])
        smalls = np.concatenate([[0], np.cumsum(small)])
        capital = upper[first] & (smalls[stop] > smalls[first])  # a text all in capitals has no names
        self.plain = word_hashes(folded, first, stop)
        digit = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
        number = digit[ends] > digit[starts]
        head = np.zeros(len(starts), bool)
        head[self.heads[:-1][np.diff(self.heads) > 0]] = True
        fresh = head.copy()
        fresh[1:] |= ENDS[buf[ends[:-1] - 1]]
        # a line feed before a word also begins a sentence
        feeds = np.concatenate([[0], np.cumsum(buf == 10)])
        fresh[1:] |= feeds[starts[1:]] > feeds[ends[:-1]]
        units = np.sort(unit_hashes())
        at = np.minimum(np.searchsorted(units, self.plain), len(units) - 1)
        unit = (units[at] == self.plain) & np.concatenate([[False], number[:-1]]) & ~head & ~number
        self.name = capital & ~fresh & ~number & ~unit
        self.slot = number | unit | self.name
        self.canon = np.where(number, NUM, np.where(unit, UNIT, np.where(self.name, NAME, self.plain)))
        # as written, without the signs around it but for a minus
        a, b = kept[first], kept[stop - 1] + 1
        a = a - ((a > starts) & (buf[a - 1] == 45))
        self.value = word_hashes(buf, a, b)


def unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    ends = np.cumsum([len(u) for u in raw])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(u) for u in raw], ends)


def windows(words: np.ndarray, heads: np.ndarray, size: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `size` words within a text: hash, first word, text number."""
    seed = np.uint64(0x51ED270B7F4A7C15 * size % 2**64) if plain else np.uint64(0)
    roll = mixed(rolling(words, size, BASES[1]) + seed)
    n = np.maximum(np.diff(heads) - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.repeat(heads[:-1], n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return (roll[at] if len(at) else np.zeros(0, np.uint64)), at, doc


def slot_lists(w: Words, at: np.ndarray, doc: np.ndarray, size: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each window the word numbers of its slots within the text, and their values."""
    places = np.flatnonzero(w.slot)
    lo, hi = np.searchsorted(places, at), np.searchsorted(places, at + size)
    n = hi - lo
    own = places[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(at) else places[:0]
    bounds = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.ListArray.from_arrays(bounds, pa.array(own - np.repeat(w.heads[doc], n), pa.int64())), pa.ListArray.from_arrays(bounds, pa.array(w.value[own].view(np.int64)))


WINDOW = "struct<pos: long, hash: long, value: array<long>>"


def item_forms(benchmark: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """(item, form, size, one, two, windows): the forms of every item that has a word; one and two are a digest of the form.

    A window has a position; the first of a template has two hashes, one as if the first word were a name, as a capitalised word inside a text is.
    """

    def forms_of(w: Words, i: int):
        part = slice(w.heads[i], w.heads[i + 1])
        canon, plain, slot, name, value = w.canon[part], w.plain[part], w.slot[part], w.name[part], w.value[part]
        n, given = len(canon), False
        if not n:
            return
        heads = np.array([0, n])
        for form in ("template", "lower"):
            if n < k or (form == "lower" and not name.any()):
                continue
            words = canon if form == "template" else np.where(name, plain, canon)
            slots = slot if form == "template" else slot & ~name
            before = np.concatenate([[0], np.cumsum(slots)])
            hashes, at, _ = windows(words, heads, k)
            usable = before[at + k] - before[at] <= k - 2  # a template of placeholders only says nothing
            twice = form == "template" and not slots[0]  # the first word is a name inside a sentence
            usable[0] &= not twice or before[k] + 1 <= k - 2
            if 2 * usable.sum() < len(at):
                continue
            given = given or form == "template"
            told = [(int(p), int(h), value[p : p + k][slots[p : p + k]]) for p, h in zip(at[usable], hashes[usable].view(np.int64), strict=True)]
            if twice and usable[0]:
                told.append((0, int(mixed(rolling(np.concatenate([[NAME], words[1:k]]), k, BASES[1]))[0].view(np.int64)), value[:k][np.concatenate([[True], slots[1:k]])]))
            _, lead, same = np.unique(value[slots], return_index=True, return_inverse=True)
            yield form, k, words.tobytes() + slots.tobytes() + lead[same].astype(np.int64).tobytes(), told
        if not given:
            size = min(n, k)
            hashes, lead = np.unique(windows(plain, heads, size, plain=True)[0].view(np.int64), return_index=True)
            yield "words", size, plain.tobytes(), [(int(p), int(h), value[:0]) for p, h in zip(lead, hashes, strict=True)]

    def run(batches):
        for t in chunks(batches, "text"):
            w, out = Words(t.column("text")), []
            ids = t.column("id").to_pylist()
            for i in range(t.num_rows):
                for form, size, seen, told in forms_of(w, i):
                    d = np.frombuffer(hashlib.blake2b(form.encode() + seen, digest_size=16).digest(), np.int64)
                    out.append({"item": ids[i], "form": form, "size": size, "one": int(d[0]), "two": int(d[1]), "windows": [{"pos": p, "hash": h, "value": v.view(np.int64).tolist()} for p, h, v in told]})
            if out:
                kind = pa.schema([("item", pa.int64()), ("form", pa.string()), ("size", pa.int32()), ("one", pa.int64()), ("two", pa.int64()), ("windows", pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64()), ("value", pa.list_(pa.int64()))])))])
                yield pa.RecordBatch.from_pylist(out, kind)

    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item long, form string, size int, one long, two long, windows array<{WINDOW}>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of (hash), two bits for each; made slice by slice in tasks, its size bounded by MOST_BITS."""
    n = hashes.count()
    bits = min(max(LEAST_BITS, int(64 * n).bit_length()), MOST_BITS)
    place = F.explode(F.array(F.col("hash"), F.shiftright("hash", 32)))
    slices = hashes.select(place.alias("h")).select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("h")).select((F.shiftright("h", LEAST_BITS)).cast("int").alias("slice"), F.col("h").bitwiseAND(F.lit((1 << LEAST_BITS) - 1)).cast("int").alias("bit")).distinct()

    def mark(rows: pa.Table) -> pa.Table:
        on = np.zeros(1 << LEAST_BITS, bool)
        on[rows.column("bit").to_numpy()] = True
        return pa.table([rows.column("slice").slice(0, 1), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (LEAST_BITS - 3)
    for r in slices.groupBy("slice").applyInArrow(mark, "slice int, bits binary").collect():
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def among(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the bitmap."""
    last = np.uint64(len(marks) * 8 - 1)
    on = lambda h: (marks[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
    near = np.flatnonzero(on(hashes & last))
    return near[on((hashes[near] >> np.uint64(32)) & last) > 0]


def held_windows(docs: DataFrame, id_col: str, text_col: str, k: int, marks: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc, id, hash, place, value): the windows of the documents that may be in the bitmap: canonical ones of k words, and plain ones of the given sizes, each once a text.

    doc is a number for every row, which holds within what one pass writes.
    """
    names = ["doc", "id", "hash", "place", "value"]

    def run(batches):
        base = TaskContext.get().partitionId() << 36
        for t in chunks(batches, "text"):
            w, id_ = Words(t.column("text")), t.column("id").combine_chunks()
            for size in (0, *sizes):
                hashes, at, doc = windows(w.plain if size else w.canon, w.heads, size or k, plain=size > 0)
                near = among(hashes, marks)
                if size and len(near):
                    near = near[np.sort(np.unique(np.stack([doc[near], hashes[near].view(np.int64)], 1), axis=0, return_index=True)[1])]
                hashes, at, doc = hashes[near], at[near], doc[near]
                if not len(near):
                    continue
                if size:
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1, np.int32)), pa.array([], pa.int64()))
                    place = value = none
                else:
                    place, value = slot_lists(w, at, doc, k)
                yield pa.RecordBatch.from_arrays([pa.array(base + doc), id_.take(pa.array(doc)), pa.array(hashes.view(np.int64)), place, value], names=names)
            base += t.num_rows

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc long, id {rows.schema['id'].dataType.simpleString()}, hash long, place array<long>, value array<long>")


def templates(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(template, item_id, form, n_items, n_windows, windows) of every template, and (template, item_id, form): which items have it; both written.

    A template goes by the smallest id of its items. Items without a word and null texts have none; repeated items have one together.
    """
    forms = spool(item_forms(benchmark, item_col, item_text, k).withColumn("row", F.monotonically_increasing_id()), "forms")
    kinds = forms.groupBy("one", "two").agg(F.min("row").alias("template"), F.min("item").alias(item_col), F.count_distinct(F.coalesce("item", F.lit(-1).cast("long") * 2**62)).alias("n_items"))
    kinds = spool(kinds, "template-kinds")
    own = forms.select(F.col("row").alias("template"), "form", "size", F.size(F.array_distinct(F.transform("windows", lambda x: x["pos"]))).cast("long").alias("n_windows"), "windows")
    members = forms.join(kinds.select("one", "two", "template"), ["one", "two"]).select("template", F.col("item").alias(item_col), "form").distinct()
    return kinds.drop("one", "two").join(own, "template"), members


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, cover: float = 0.8) -> DataFrame:
    """(id, item_id, form, n_items, n_windows, n_found, n_slots, n_changed): the templates that each contaminated document holds.

    item_id is the smallest item of the template and n_items the number of its items, which `templates` lists. n_windows and n_found: windows of
    the template and those found; n_slots: slots of these in the document, n_changed: those whose value differs from that item's own.
    Documents count by themselves, rows with a null or repeated id, too; ids may be of any type. Items without a word and null or empty texts on either side take no part.
    Texts of any length are read whole. Short items, and those that are mostly numbers and names, are found by their plain words without signs
    only, so `17 + 23` counts for `17 * 23`, and very short ones in every document that has their words side by side. Other columns are not
    looked at. Empty tables give an empty result.
    """
    kinds, _ = templates(benchmark, item_col, item_text, k)
    kinds = spool(kinds, "templates")
    asked = spool(kinds.select("template", "n_windows", F.explode("windows").alias("w")).select("template", "n_windows", "w.pos", "w.hash", F.col("w.value").alias("asked")), "template-windows")
    sizes = sorted(r[0] for r in kinds.where("form = 'words'").select("size").distinct().collect())  # k at most
    hashes = asked.select("hash").distinct()
    marks = bitmap(hashes)
    hits = spool(held_windows(docs, id_col, text_col, k, marks, sizes).join(hashes, "hash", "left_semi"), "hits")
    # of these windows of a template a contaminated document cannot lack all
    often = hits.groupBy("hash").agg(F.count("*").alias("n"))
    rarity = asked.join(often, "hash", "left").groupBy("template", "n_windows", "pos").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_list("hash").alias("hashes"))
    nth = F.row_number().over(W.partitionBy("template").orderBy("n", "pos"))
    probes = rarity.withColumn("nth", nth).where((F.col("nth") <= F.col("n_windows") - F.ceil(F.col("n_windows") * F.lit(cover)) + 1) & (F.col("n") > 0)).select("template", F.explode("hashes").alias("hash")).distinct()
    pairs = hits.select("doc", "hash").distinct().join(probes, "hash").select("doc", "template").distinct()
    met = pairs.join(asked, "template").join(hits, ["doc", "hash"])
    met = spool(met.select("doc", "id", "template", "n_windows", "pos", "place", "value", "asked"), "met")
    found = met.groupBy("doc", "id", "template", "n_windows").agg(F.count_distinct("pos").alias("n_found")).where(F.col("n_found") >= F.lit(cover) * F.col("n_windows"))
    # a document value belongs to an item value if no other does more often
    zipped = met.where(F.size("place") > 0).select("doc", "template", F.explode(F.arrays_zip("place", "value", "asked")).alias("z")).select("doc", "template", "z.*").distinct()
    each = zipped.groupBy("doc", "template", "asked", "value").agg(F.count("*").alias("n"))
    best = each.groupBy("doc", "template", "asked").agg(F.sum("n").alias("n"), F.max(F.struct("n", "value")).alias("best"))
    slots = best.groupBy("doc", "template").agg(F.sum("n").alias("n_slots"), F.sum("best.n").alias("n_same"), F.sum(F.when(F.col("best.value") != F.col("asked"), F.col("best.n")).otherwise(0)).alias("n_changed"))
    both = found.join(slots, ["doc", "template"], "left").na.fill(0, ["n_slots", "n_same", "n_changed"]).where(F.col("n_same") >= F.lit(cover) * F.col("n_slots"))
    out = both.join(kinds.select("template", F.col(item_col).alias("item"), "form", "n_items"), "template")
    out = out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "form", "n_items", "n_windows", "n_found", "n_slots", "n_changed")
    out = spool(out, "contaminated")
    release(kinds, asked, hits, met)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op9: which of all `documents` hold which templates of `benchmark`; items: the members of a template, in the row of its first document."""
    from docweave.functions.session import spread, table

    benchmark = table(spark, sf_dir, "benchmark")
    found = contaminated(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), benchmark)
    kinds, members = templates(benchmark)
    listed = members.join(kinds.select("template", F.col("item_id").alias("head")), "template").groupBy("head", "form").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    first = found.groupBy("item_id", "form").agg(F.min("doc_id").alias("doc_id"))
    told = first.join(listed, (first["item_id"] == listed["head"]) & (first["form"] == listed["form"])).select(first["doc_id"], "item_id", first["form"], "items")
    return found.join(told, ["doc_id", "item_id", "form"], "left")
