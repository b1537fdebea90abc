"""Operator 2: benchmark decontamination by MinHash containment search. DataFrame functions only.

Items are partitioned by size: a class holds those of 2 ** c to 2 ** (c + 1) - 1 distinct five-word shingles. The class sets how many
bottom-k hashes its items' sketches have: as many as its largest item may lack, and a few more. So a document that contains
the threshold share of an item meets a known number of its sketch's hashes at least. All shingles of a long
document, window by window, look the sketches up, in the classes that its length leaves possible; pairs that meet
often enough are candidates, verified by exact containment of shingles as text. An item of fewer words is one
shingle of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

SHINGLE = 5
#: Rows of two or three longs that are broadcast at most (some 50 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Hashes of a sketch beyond those that a document may lack.
SPARE = 4
#: Parts that the documents' shingles are dealt over where the sketches are too many to broadcast: splits the common ones.
DEALT = 16


def windows(w: Column, make, n: int) -> Column:
    """make(words) for every window of n of the words."""
    one = lambda i: make(*(F.get(w, i + k) for k in range(n)))
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one)).otherwise(F.array())


def shingles(text: Column, make, sizes: list[int]) -> Column:
    """The windows of these sizes, repeats included.

    The words are the variable of an outer lambda: so they are split once for each text, even
    where the optimizer copies this expression into a filter.
    """
    each = lambda w: windows(w, make, sizes[0]) if len(sizes) == 1 else F.concat(*(windows(w, make, n) for n in sizes))
    return F.coalesce(F.transform(F.array(words(text)), each)[0], F.array())


def item_shingles(text: Column, make) -> Column:
    """The windows of SHINGLE words; of fewer words the whole sequence; of none nothing."""

    def each(w):
        out = windows(w, make, SHINGLE)
        for n in range(1, SHINGLE):
            out = F.when(F.size(w) == n, windows(w, make, n)).otherwise(out)
        return out

    return F.array_distinct(F.coalesce(F.transform(F.array(words(text)), each)[0], F.array()))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only where the counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every pair that reaches the threshold.

    Containment is the share of the item's distinct shingles that the document has. An item of one to four words
    is one shingle, which the document must have as a run of words; one without words matches nothing. Null texts are
    empty; rows without an id are left out; repeated rows of a document or an item count once, of different texts under one id
    the best pair counts; empty tables give an empty result; other columns are left out.
    """
    docs = texts(docs, id_col, text_col).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null").dropDuplicates()
    signed = items.select("item_id", F.xxhash64("text").alias("variant"), F.size(words(F.col("text"))).alias("n_words"), F.array_sort(item_shingles(F.col("text"), F.xxhash64)).alias("h")).where(F.size("h") > 0)
    signed = cut(signed)
    short = signed.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect()  # four sizes at most
    sizes = [SHINGLE, *sorted(r.n_words for r in short)]
    n, size_class = F.size("h"), F.floor(F.log2(F.size("h"))).cast("int")
    lacks = lambda n: (n - F.ceil(F.lit(threshold) * n - 1e-9)).cast("int")
    largest = F.pow(F.lit(2), size_class + 1).cast("int") - 1
    sketch = F.slice("h", F.lit(1), lacks(largest) + SPARE)
    sketches = signed.select("item_id", "variant", size_class.alias("size_class"), (F.size(sketch) - lacks(n)).alias("least"), F.explode(sketch).alias("h"))
    # a text has no more words, and so no more shingles, than half its characters
    most = F.floor(F.log2(F.greatest((F.length("text") + 1) / 2 * len(sizes) / threshold, F.lit(1.0)))).cast("int")
    # outer: a plain explode would have the array computed once more, to filter by its size
    # most: below the explode, which would otherwise carry the text along with each of its shingles
    searched = docs.select("doc_id", "text", most.alias("most")).select("doc_id", "most", F.explode_outer(shingles(F.col("text"), F.xxhash64, sizes)).alias("h"))
    n_sketch = sketches.count()
    if n_sketch <= BROADCAST_ROWS:
        met = searched.join(F.broadcast(sketches), "h")
    else:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)).cast("int")
        met = searched.withColumn("part", part).join(sketches.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))), ["h", "part"])
    met = met.where("size_class <= most").select("doc_id", "item_id", "variant", "least", "h").distinct()
    met = met.groupBy("doc_id", "item_id", "variant").agg(F.count("*").alias("hits"), F.first("least").alias("least")).where("hits >= least").select("doc_id", "item_id").distinct()
    met = cut(met)
    wanted = met.select("doc_id").distinct()
    text = lambda *w: F.concat_ws(" ", *w)
    n_met = met.count()
    found = docs.join(bounded(wanted, n_met), "doc_id", "left_semi").select("doc_id", F.array_distinct(shingles(F.col("text"), text, sizes)).alias("has"))
    asked = items.select("item_id", item_shingles(F.col("text"), text).alias("asked"))
    n_items = items.agg(F.sum(F.length("text"))).first()[0] or 0
    pairs = found.join(bounded(met, n_met), "doc_id").join(bounded(asked, n_items // 8), "item_id")
    shared = pairs.select("doc_id", "item_id", F.size("asked").cast("long").alias("n_shingles"), F.size(F.array_intersect("asked", "has")).cast("long").alias("n_shared"))
    best = shared.where("n_shingles > 0").groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_shared"), F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shingles")).alias("x")).select("doc_id", "item_id", "x.*")
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold - 1e-9)


#: The same pairs over the tables, for DuckDB.
LEAKS_SQL = """
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents),
  i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from benchmark),
  z as (select distinct least(len(w), 5) as n from i where len(w) > 0),
  ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as s from d, z where len(w) >= n),
  s as (select distinct item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda k: array_to_string(w[k:k + least(len(w), 5) - 1], ' '))) as s from i where len(w) > 0),
  n as (select item_id, count(*) as n_shingles from s group by item_id),
  m as (select doc_id, item_id, count(*) as n_shared from ds join s using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, n_shared::double / n_shingles as containment from m join n using (item_id) where n_shared >= 0.8 * n_shingles - 1e-9
"""
