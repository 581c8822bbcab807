"""Image dataset checks: structure, labels, duplicates, category and box normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinewatch.functions.scalars import hamming_distance
from kinewatch.operators.geometry import split_valid
from kinewatch.operators.lineage import cut
from kinewatch.operators.slices import small

# Expected class names, the clip allowance in pixels, and the slack of a box check.
EXPECTED_CLASSES = ("fallen", "lying", "sitting", "standing")
MAX_CLIP_PIXELS = 0.05
BOX_SLACK = 1e-6
SPLIT_ORDER = ("train", "validation", "test")


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def _flag(df: DataFrame, marked: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.join(marked.select(*keys).withColumn(name, F.lit(True)), keys, "left")


def validate_coco_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique id per split, positive size, a path inside the split, true size as declared."""
    keys = ["split", "image_id"]
    rows = _flag(images, repeated(images, keys), keys, "_dup")
    c = F.col
    depth = F.aggregate(
        F.split(F.translate("file_name", "\\", "/"), "/"),
        F.struct(F.lit(0).alias("d"), F.lit(False).alias("out")),
        lambda a, part: F.struct(
            (a["d"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("d"),
            (a["out"] | ((part == "..") & (a["d"] == 0))).alias("out")))
    rules = {
        "duplicate_image_id": c("_dup"),
        "missing_file_name": F.coalesce(F.length("file_name"), F.lit(0)) == 0,
        "bad_size": c("width").isNull() | c("height").isNull() | (c("width") <= 0) | (c("height") <= 0),
        "path_escapes_split": depth["out"] | c("file_name").startswith("/"),
    }
    if "actual_width" in images.columns:
        rules["size_disagrees"] = (c("actual_width") != c("width")) | (c("actual_height") != c("height"))
    good, bad = split_valid(rows, rules)
    return good.drop("_dup"), bad.drop("_dup")


def validate_coco_annotations(annotations: DataFrame, images: DataFrame,
                              categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique id per split, known image and category, finite box inside its image."""
    keys = ["split", "annotation_id"]
    rows = _flag(annotations, repeated(annotations, keys), keys, "_dup")
    size = images.select("split", "image_id", F.col("width").alias("_iw"),
                         F.col("height").alias("_ih")).dropDuplicates(["split", "image_id"])
    rows = rows.join(size, ["split", "image_id"], "left")
    rows = _flag(rows, categories.select("split", "category_id").distinct(),
                 ["split", "category_id"], "_cat")
    c = F.col
    bad_number = _not_finite(c("x")) | _not_finite(c("y")) | _not_finite(c("w")) | _not_finite(c("h"))
    good, bad = split_valid(rows, {
        "duplicate_annotation_id": c("_dup"),
        "unknown_image": c("_iw").isNull(),
        "unknown_category": c("_cat").isNull(),
        "bad_box": bad_number,
        "box_outside_image": (c("x") < 0) | (c("y") < 0) | (c("w") <= 0) | (c("h") <= 0)
        | (c("x") + c("w") > c("_iw") + BOX_SLACK) | (c("y") + c("h") > c("_ih") + BOX_SLACK),
    })
    extra = ["_dup", "_iw", "_ih", "_cat"]
    return good.drop(*extra), bad.drop(*extra)


def empty_splits(images: DataFrame, annotations: DataFrame, splits: DataFrame) -> DataFrame:
    """Expected splits without images or without annotations."""
    has_i = images.select("split").distinct().withColumn("_i", F.lit(True))
    has_a = annotations.select("split").distinct().withColumn("_a", F.lit(True))
    return splits.join(has_i, "split", "left").join(has_a, "split", "left").filter(
        F.col("_i").isNull() | F.col("_a").isNull()).select("split")


def annotation_integrity(annotations: DataFrame, images: DataFrame,
                         categories: DataFrame) -> DataFrame:
    """Annotations that name an unknown image or category, one row per broken reference."""
    no_image = annotations.join(images.select("split", "image_id"), ["split", "image_id"], "left_anti")
    no_cat = annotations.join(
        categories.select("split", "category_id"), ["split", "category_id"], "left_anti")
    return (no_image.select("split", "annotation_id", F.lit("unknown_image").alias("rule"))
            .unionByName(no_cat.select("split", "annotation_id", F.lit("unknown_category").alias("rule"))))


def split_summary(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Per split: images, annotations and the count of every class that occurs, by category id."""
    i = images.groupBy("split").agg(F.count("*").alias("images"))
    per = annotations.groupBy("split", "category_id").agg(F.count("*").alias("n"))
    named = per.join(categories.select("split", "category_id", "name"), ["split", "category_id"])
    entry = F.struct("category_id", F.struct(F.col("name"), F.col("n")).alias("e"))
    a = named.groupBy("split").agg(
        F.sum("n").alias("annotations"), F.array_sort(F.collect_list(entry)).alias("c"))
    return i.join(a, "split").select(
        "split", "images", "annotations",
        F.array_join(F.transform("c", lambda x: F.concat(
            x["e"]["name"], F.lit("="), x["e"]["n"].cast("string"))), ",").alias("class_annotations"))


def category_usage(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations per category and split, with zeros."""
    n = annotations.groupBy("split", "category_id").agg(F.count("*").alias("annotations"))
    return categories.join(n, ["split", "category_id"], "left").select(
        "split", "category_id", "name", F.coalesce("annotations", F.lit(0)).alias("annotations"))


def check_category_schema(categories: DataFrame, reference: str = "train") -> DataFrame:
    """Categories that differ from the reference split, in either direction."""
    ref = categories.filter(F.col("split") == reference).select("category_id", "name")
    other = categories.select("split").distinct().filter(F.col("split") != reference)
    # the category list is repeated once per split
    want = other.crossJoin(ref).select("split", "category_id", "name")
    have = categories.filter(F.col("split") != reference).select("split", "category_id", "name")
    return (want.exceptAll(have).withColumn("rule", F.lit("missing"))
            .unionByName(have.exceptAll(want).withColumn("rule", F.lit("unexpected"))))


def class_set_check(categories: DataFrame, expected: tuple[str, ...] = EXPECTED_CLASSES) -> DataFrame:
    """Observed lower-cased class names per split and whether they are the expected set."""
    names = F.array_sort(F.collect_set(F.lower("name")))
    return categories.groupBy("split").agg(names.alias("names")).select(
        "split", F.array_join("names", ",").alias("names"),
        (F.col("names") == F.array(*[F.lit(e) for e in sorted(expected)])).alias("as_expected"))


def category_keepers(annotations: DataFrame, categories: DataFrame,
                     reference: str = "train") -> tuple[DataFrame, DataFrame]:
    """(mapping, ambiguous names). Same-named categories collapse onto the only used one.

    mapping: category_id, name, keeper_id, new_category_id (contiguous by keeper id), dropped.
    """
    used = annotations.groupBy("category_id").agg(F.count("*").alias("annotations"))
    cats = categories.filter(F.col("split") == reference).join(used, "category_id", "left").select(
        "category_id", "name", F.lower("name").alias("key"),
        F.coalesce("annotations", F.lit(0)).alias("annotations"))
    is_used = F.col("annotations") > 0
    by_name = cats.groupBy("key").agg(
        F.count("*").alias("same"), F.count_if(is_used).alias("used"),
        F.min("category_id").alias("first_id"),
        F.min(F.when(is_used, F.col("category_id"))).alias("used_id"))
    clash = (F.col("same") > 1) & (F.col("used") != 1)
    keep = by_name.filter(~clash).withColumn(
        "keeper_id", F.when(F.col("same") > 1, F.col("used_id")).otherwise(F.col("first_id")))
    # one row per class name: a list as short as the label set
    new_id = F.row_number().over(Window.orderBy("keeper_id")) - 1
    keep = keep.withColumn("new_category_id", new_id.cast("long"))
    mapping = cats.join(keep.select("key", "keeper_id", "new_category_id"), "key").select(
        "category_id", "name", "keeper_id", "new_category_id",
        (F.col("category_id") != F.col("keeper_id")).alias("dropped"), "annotations")
    return mapping, by_name.filter(clash).select("key", "same", "used")


def remap_categories(annotations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Old to contiguous category ids; Spark broadcasts the mapping when its measured size allows."""
    to = mapping.select("category_id", "new_category_id")
    return annotations.join(to, "category_id").drop("category_id").withColumnRenamed(
        "new_category_id", "category_id")


def clip_bbox_rounding(annotations: DataFrame, images: DataFrame,
                       limit: float = MAX_CLIP_PIXELS) -> tuple[DataFrame, DataFrame]:
    """Clamps export-rounding overflow at the image border; larger corrections are rejected.

    The result keeps `clip_pixels`; `area` is recomputed only where present and clipped.
    """
    size = images.select("split", "image_id", F.col("width").cast("double").alias("_iw"),
                         F.col("height").cast("double").alias("_ih"))
    c = F.col
    rows = annotations.join(size, ["split", "image_id"], "left")

    def clamp(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), top)

    x2, y2 = c("x") + c("w"), c("y") + c("h")
    rows = rows.withColumns({
        "_x1": clamp(c("x"), c("_iw")), "_y1": clamp(c("y"), c("_ih")),
        "_x2": clamp(x2, c("_iw")), "_y2": clamp(y2, c("_ih"))})
    rows = rows.withColumn("clip_pixels", F.greatest(
        F.abs(c("_x1") - c("x")), F.abs(c("_y1") - c("y")), F.abs(c("_x2") - x2),
        F.abs(c("_y2") - y2)))
    good, bad = split_valid(rows, {
        "bad_box": c("_iw").isNull() | _not_finite(c("x")) | _not_finite(c("y"))
        | _not_finite(c("w")) | _not_finite(c("h")),
        "non_positive_box": (c("w") <= 0) | (c("h") <= 0),
        "clip_too_large": c("clip_pixels") > limit + 1e-9,
        "empty_after_clip": (c("_x2") - c("_x1") <= 0) | (c("_y2") - c("_y1") <= 0),
    })
    clipped = c("clip_pixels") > 0
    w, h = c("_x2") - c("_x1"), c("_y2") - c("_y1")
    new = {"x": F.when(clipped, c("_x1")).otherwise(c("x")),
           "y": F.when(clipped, c("_y1")).otherwise(c("y")),
           "w": F.when(clipped, w).otherwise(c("w")), "h": F.when(clipped, h).otherwise(c("h"))}
    if "area" in annotations.columns:
        new["area"] = F.when(clipped & c("area").isNotNull(), w * h).otherwise(c("area"))
    tmp = ["_iw", "_ih", "_x1", "_y1", "_x2", "_y2"]
    return good.withColumns(new).drop(*tmp), bad.drop(*tmp)


def bbox_adjustment_summary(clipped: DataFrame) -> DataFrame:
    """Per split: adjusted annotations and the largest correction."""
    adj = F.col("clip_pixels") > 0
    return clipped.groupBy("split").agg(
        F.count_if(adj).alias("adjusted"),
        F.coalesce(F.max(F.when(adj, F.col("clip_pixels"))), F.lit(0.0)).alias("maximum_clip_pixels"))


def bbox_adjustment_examples(clipped: DataFrame, n: int = 20) -> DataFrame:
    """First n adjusted annotations per split; the limit is applied before the shuffle too."""
    w = Window.partitionBy("split").orderBy("annotation_id")
    rows = clipped.filter("clip_pixels > 0").withColumn("position", F.row_number().over(w))
    return rows.filter(F.col("position") <= n)


def cross_split_exact_duplicates(files: DataFrame, digest: str = "sha256",
                                 path: str = "relative_path") -> DataFrame:
    """Every file whose content occurs in more than one split, with the splits of that content.

    Splits per digest are counted on distinct (digest, split) pairs, so copies of one file collapse
    before they meet.
    """
    pairs = files.groupBy(digest, "split").agg(F.count("*").alias("_n"))
    shared = pairs.groupBy(digest).agg(
        F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits"),
        F.count("*").alias("_k"), F.sum("_n").alias("copies")).filter("_k > 1").drop("_k")
    return files.join(shared, digest).select(digest, path, "split", "splits", "copies")


# --- near duplicates -----------------------------------------------------------------------------

LEVELS = 3  # band, band within band, and once more: keys of about 13, 23 and 31 of the 64 bits


def near_duplicate_hashes(hashes: DataFrame, distance: int = 4, bucket_limit: int = 20_000
                          ) -> DataFrame:
    """Pairs of distinct 64-bit hashes within the distance: a_hash <= b_hash, distance.

    Two hashes within d agree on at least one of d+1 bit bands, so only hashes equal on a band are
    compared. A band value shared by too many hashes is split again: its members agree there, so
    they must also agree on one of d+1 bands of their other bits. One small count decides whether
    a further level is needed. What the last level leaves too large is dealt into blocks that meet
    two by two. Copies were collapsed beforehand, and every pair is found once.
    """
    k = distance + 1
    rows = cut(hashes.select("dhash").distinct()).withColumns(
        {"_node": F.lit(0), "_key": F.array().cast("array<bigint>")})
    nodes: list[list[list[int]]] = [[]]  # per node the bands fixed on the way to it
    found = None
    for level in range(LEVELS):
        bands = [_split_bits(_free_bits(fixed), k) for fixed in nodes]
        masks = [_mask(b) for per in bands for b in per]
        table = F.array(*[F.lit(m).cast("long") for m in masks])
        keyed = rows.withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        mask = F.element_at(table, F.col("_node") * k + F.col("_band") + 1)
        value = F.col("dhash").bitwiseAND(mask)
        keyed = keyed.withColumn("_key", F.concat("_key", F.array(value)))
        keyed = keyed.withColumn("_node", F.col("_node") * k + F.col("_band")).drop("_band")
        checks = _earlier(nodes, bands, k)
        last = level == LEVELS - 1 or min(len(_free_bits(f)) for f in nodes) < 2 * k
        big = None
        if not last:
            size = keyed.groupBy("_node", "_key").agg(F.count("*").alias("_n")).filter(
                F.col("_n") > bucket_limit)
            big = cut(size.select("_node", "_key"))
            last = big.isEmpty()
        if last:
            sizes = None
            if big is None:  # no band is left to split by
                sizes = cut(keyed.groupBy("_node", "_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > bucket_limit))
                sizes = None if sizes.isEmpty() else sizes
            return _compare(_in_blocks(keyed, sizes, bucket_limit), checks, distance, found)
        fits = keyed.join(big, ["_node", "_key"], "left_anti")
        found = _compare(_in_blocks(fits, None, bucket_limit), checks, distance, found)
        rows = cut(keyed.join(big, ["_node", "_key"], "left_semi"))
        nodes = [[*fixed, band] for fixed, per in zip(nodes, bands) for band in per]
    return found


def _earlier(nodes: list, bands: list, k: int) -> list[list[int]]:
    """Per child node the masks that must all differ, or the pair was met in an earlier bucket."""
    out = []
    for fixed, per in zip(nodes, bands):
        seen: list[int] = []
        taken: list[list[int]] = []
        for band in fixed:  # bands before the chosen one on every outer level
            options = _split_bits(_free_bits(taken), k)
            seen += [_mask(o) for o in options[: options.index(band)]]
            taken.append(band)
        out += [seen + [_mask(b) for b in per[:j]] for j in range(k)]
    return out


def _free_bits(fixed: list[list[int]]) -> list[int]:
    taken = {b for band in fixed for b in band}
    return [b for b in range(64) if b not in taken]


def _split_bits(bits: list[int], k: int) -> list[list[int]]:
    cuts = [len(bits) * i // k for i in range(k + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(band: list[int]) -> int:
    m = sum(1 << b for b in band)
    return m - (1 << 64) if m >= 1 << 63 else m


def _in_blocks(keyed: DataFrame, sizes: DataFrame | None, limit: int) -> DataFrame:
    """Adds `_own`, the block of a hash in its bucket, and `_blocks`, their number: one of at most `limit` where sizes has none."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    if sizes is None:
        return keyed.withColumns({"_blocks": one, "_own": none})
    dealt = keyed.join(small(sizes), ["_node", "_key"], "left")
    count = F.coalesce(F.ceil(F.col("_n") / F.lit(limit / 2)).cast("long"), one)  # half of the limit on average
    return dealt.withColumn("_blocks", count).withColumn("_own", F.pmod(F.xxhash64("dhash"), F.col("_blocks"))).drop("_n")


def _compare(keyed: DataFrame, checks: list[list[int]], distance: int,
             found: DataFrame | None) -> DataFrame:
    """Compares hashes within a bucket and keeps a pair only in its first common bucket.

    Blocks i <= j of a bucket meet in one group: a hash goes to the left of all groups (own, j) and to the right of all (i, own).
    """
    on = ["_node", "_key", "_i", "_j"]
    later = F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1))
    earlier = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_own")))
    x = keyed.select("_node", "_key", F.col("_own").alias("_i"), later.alias("_j"), F.col("dhash").alias("_x"))
    y = keyed.select("_node", "_key", F.col("_own").alias("_j"), earlier.alias("_i"), F.col("dhash").alias("_y"))
    diff = F.col("_x").bitwiseXOR(F.col("_y"))
    gap = hamming_distance(F.col("_x"), F.col("_y"))
    none = F.array().cast("array<bigint>")
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in c]) if c else none for c in checks])
    first = F.forall(F.element_at(table, F.col("_node") + 1), lambda m: diff.bitwiseAND(m) != 0)
    once = (F.col("_i") < F.col("_j")) | (F.col("_x") <= F.col("_y"))
    # the cheap distance test comes first; few pairs reach the second
    pairs = x.join(y, on).filter(once & (gap <= distance)).filter(first).select(
        F.least("_x", "_y").alias("a_hash"), F.greatest("_x", "_y").alias("b_hash"), gap.alias("distance"))
    return pairs if found is None else found.unionByName(pairs)


def _split_rank(split: Column, order: tuple) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order]), split)


def near_duplicate_groups(files: DataFrame, distance: int = 4, order: tuple = SPLIT_ORDER,
                          bucket_limit: int = 20_000) -> DataFrame:
    """Cross-split near-duplicates as groups: (split, hash) against (split, hash) with pair counts.

    files: image_id, split, dhash, sha256. Files of equal content do not count. A group of copies
    stays one row, so the number of pairs is exact without listing them.
    """
    files = cut(files.select("split", "dhash", "sha256"))  # read three times below
    counts = files.groupBy("split", "dhash").agg(F.count("*").alias("n"))
    same = files.groupBy("dhash", "sha256", "split").agg(F.count("*").alias("n"))
    near = near_duplicate_hashes(files, distance, bucket_limit)
    # both orientations, the equal pair once
    there, back = F.struct("a_hash", "b_hash"), F.struct(F.col("b_hash").alias("a_hash"), F.col("a_hash").alias("b_hash"))
    ways = F.when(F.col("a_hash") == F.col("b_hash"), F.array(there)).otherwise(F.array(there, back))
    both = near.select("distance", F.explode(ways).alias("way")).select("way.a_hash", "way.b_hash", "distance")
    left = counts.select(F.col("dhash").alias("a_hash"), F.col("split").alias("first_split"),
                         F.col("n").alias("n1"))
    right = counts.select(F.col("dhash").alias("b_hash"), F.col("split").alias("second_split"),
                          F.col("n").alias("n2"))
    pairs = both.join(left, "a_hash").join(right, "b_hash").filter(
        _split_rank(F.col("first_split"), order) < _split_rank(F.col("second_split"), order))
    # equal content under the two hashes, counted from per-content totals
    s1 = same.select("sha256", F.col("dhash").alias("a_hash"), F.col("split").alias("first_split"),
                     F.col("n").alias("m1"))
    s2 = same.select("sha256", F.col("dhash").alias("b_hash"), F.col("split").alias("second_split"),
                     F.col("n").alias("m2"))
    equal = s1.join(s2, "sha256").filter(
        _split_rank(F.col("first_split"), order) < _split_rank(F.col("second_split"), order)
    ).groupBy("a_hash", "b_hash", "first_split", "second_split").agg(
        F.sum(F.col("m1") * F.col("m2")).alias("eq"))
    keys = ["a_hash", "b_hash", "first_split", "second_split"]
    out = pairs.join(equal, keys, "left").withColumn(
        "pairs", F.col("n1") * F.col("n2") - F.coalesce("eq", F.lit(0)))
    return out.filter("pairs > 0").select(
        "first_split", "second_split", F.col("a_hash").alias("first_hash"),
        F.col("b_hash").alias("second_hash"), "distance", "pairs")


def near_duplicate_examples(files: DataFrame, groups: DataFrame, limit: int = 100,
                            order: tuple = SPLIT_ORDER) -> DataFrame:
    """First `limit` pairs by split pair, first image and second image.

    At most `limit` first images can appear, so they are picked before any pair is formed.
    """
    r1, r2 = _split_rank(F.col("first_split"), order), _split_rank(F.col("second_split"), order)
    g = groups.withColumns({"r1": r1, "r2": r2})
    first = files.select(F.col("image_id").alias("first_id"), F.col("split").alias("first_split"),
                         F.col("dhash").alias("first_hash"), F.col("sha256").alias("first_sha"))
    second = files.select(F.col("image_id").alias("second_id"), F.col("split").alias("second_split"),
                          F.col("dhash").alias("second_hash"), F.col("sha256").alias("second_sha"))
    # a first image has a partner unless all partners hold its own content
    partners = g.groupBy("r1", "r2", "first_split", "second_split", "first_hash").agg(
        F.sum("pairs").alias("_p"))
    heads = first.join(partners, ["first_split", "first_hash"])
    own = files.groupBy(F.col("sha256").alias("first_sha"), F.col("split").alias("second_split"),
                        F.col("dhash").alias("second_hash")).agg(F.count("*").alias("_own"))
    sizes = files.groupBy(F.col("split").alias("second_split"), F.col("dhash").alias("second_hash")
                          ).agg(F.count("*").alias("_all"))
    links = g.select("r1", "r2", "first_split", "second_split", "first_hash", "second_hash").join(
        sizes, ["second_split", "second_hash"])
    live = heads.select("r1", "r2", "first_split", "second_split", "first_hash", "first_sha").distinct(
    ).join(links, ["r1", "r2", "first_split", "second_split", "first_hash"]).join(
        own, ["first_sha", "second_split", "second_hash"], "left").filter(
        F.col("_all") > F.coalesce("_own", F.lit(0))).select(
        "r1", "r2", "first_hash", "first_sha").distinct()
    heads = heads.join(live, ["r1", "r2", "first_hash", "first_sha"], "left_semi")
    top = heads.orderBy("r1", "r2", "first_id").limit(limit)
    pairs = top.select("r1", "r2", "first_id", "first_split", "second_split", "first_hash", "first_sha"
                       ).join(g.select("first_split", "second_split", "first_hash", "second_hash",
                                       "distance"), ["first_split", "second_split", "first_hash"]
                              ).join(second, ["second_split", "second_hash"])
    return pairs.filter("first_sha <> second_sha").orderBy("r1", "r2", "first_id", "second_id").limit(
        limit).select("first_split", "second_split", "first_id", "second_id", "distance")


def manifest_drift(audited: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose content is missing or changed since the audit, and files the audit never saw."""
    a = audited.select("path", F.col("sha256").alias("audited_sha256"))
    c = current.select("path", F.col("sha256").alias("current_sha256"))
    status = (F.when(F.col("current_sha256").isNull(), F.lit("missing"))
              .when(F.col("audited_sha256").isNull(), F.lit("unaudited"))
              .when(F.col("audited_sha256") != F.col("current_sha256"), F.lit("changed")))
    return a.join(c, "path", "full").select("path", status.alias("status")).filter(
        F.col("status").isNotNull())
