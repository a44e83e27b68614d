"""Spellings of names typed by people, linked when they name the same person or group.

1. Strings that differ only in case, accents, punctuation, titles, marks or order collapse to one node.
2. A node is a vector of the character 3-grams of its words, weighted by rarity. Nodes are joined on
   the grams of their prefix: the rarest grams that hold all but ``COSINE`` squared of the vector, so
   that no pair of at least that cosine is missed. The nodes of a gram are multiplied as a matrix, in
   blocks where they are many; a pair comes out at its first common gram only. ``top_n`` keeps a
   node's best partners only; the default keeps all.
   A surname in a large share of all names weighs little, so names with a word of at least ``HOT_SHARE``
   of the nodes are also paired on that word and an initial of another part, whatever their cosine.
3. Pairs must pass a comparison of their words (initials, nicknames, short forms, typing errors). Names
   that links connect and that contradict each other (other given name, other middle initial) get a
   negative similarity, whatever their cosine.
4. The pairs' similarities are grouped by average linkage: clusters that are each other's nearest
   merge, round by round, while their average is at least ``LINKAGE``; pairs that were not found
   count as 0. Average linkage is reducible, so merging all mutual nearest neighbours at once gives
   the tree of one-by-one merging. No component is collected anywhere.

Nodes are keyed by 64-bit hashes of their normal forms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.components import connected_components
from folio.session import Scratch

COSINE = 0.35
POWER = 3.0  # of a gram's log rarity: surnames weigh more than given names
LINKAGE = 0.3
CONTRADICTION = -0.5
HOT = 1_500  # nodes of a block; pairs of blocks are compared
COLUMNS = 4_096  # grams of a block multiplied at once
ROUNDING = 1e-4  # of cosines in 32 bits; pairs below the threshold by less are kept
HOT_SHARE = 0.01  # of all nodes: from here on a surname and an initial alone may miss COSINE
RARE = 0.002  # grams in less than this share of nodes (typing errors among them) weigh alike

# Short forms of given names.
NICKNAMES = {
    "abe": "abraham", "al": "albert", "alex": "alexander", "sasha": "alexander", "andy": "andrew", "tony": "anthony", "toni": "antonia",
    "bart": "bartholomew", "barb": "barbara", "ben": "benjamin", "benny": "benjamin", "bill": "william", "billy": "william", "will": "william",
    "bob": "robert", "bobby": "robert", "rob": "robert", "cathy": "catherine", "charlie": "charles", "chuck": "charles", "chris": "christopher",
    "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "dima": "dmitri", "mitya": "dmitri",
    "dora": "theodora", "ed": "edward", "eddie": "edward", "ted": "edward", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth",
    "liz": "elizabeth", "lizzie": "elizabeth", "fran": "francisco", "paco": "francisco", "frank": "francis", "gianni": "giovanni", "nino": "giovanni",
    "vanni": "giovanni", "greg": "gregory", "lupe": "guadalupe", "lupita": "guadalupe", "hans": "johannes", "hank": "henry", "harry": "henry",
    "jim": "james", "jimmy": "james", "jen": "jennifer", "jenny": "jennifer", "jack": "john", "johnny": "john", "joe": "joseph", "pepe": "jose",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "katya": "yekaterina", "katia": "yekaterina",
    "larry": "lawrence", "lucy": "lucia", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "matt": "matthew",
    "mike": "michael", "mick": "michael", "misha": "mikhail", "mo": "mohammed", "nick": "nicholas", "nikos": "nikolaos", "niko": "nikolaos",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "dick": "richard", "rich": "richard",
    "rick": "richard", "becky": "rebecca", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susanna", "susie": "susanna",
    "sanna": "susanna", "theo": "theodora", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vic": "victoria",
    "tori": "victoria", "zosia": "zofia", "ibo": "ibrahim", "jo": "johannes", "cris": "cristina", "josh": "joshua", "ron": "ronald", "ray": "raymond",
}
# Words that carry no name.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "md", "msc", "bsc", "phd", "mph", "ma", "ba", "dphil", "frcp", "rn", "jr", "sr", "sir", "dipl", "ing", "habil", "med", "corresponding", "author", "behalf"}
FILLERS = {"the", "of", "for", "and", "on", "in", "de", "la", "van", "von", "der", "den", "del", "di", "da", "el", "al", "bin", "ter", "le", "les", "du", "des", "dos", "das", "zu"}
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"})
_LOOKS = str.maketrans("013458", "olease")
_ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_PIECE = re.compile(r"[^\W_]+(?:[’'`‐-―\-]+[^\W_]+)*(\.?)")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).casefold().translate(_PLAIN)


def parse(name: str) -> tuple[list[str], list[str]]:
    """(full words, initials) of a name. A hyphened word keeps its hyphen."""
    text = unicodedata.normalize("NFKC", _ASIDE.sub(" ", name))
    found = [(m.group(0).rstrip("."), bool(m.group(1))) for m in _PIECE.finditer(text)]
    letters = [c for c in text if c.isalpha()]
    shouted = bool(letters) and all(c.isupper() for c in letters if c.upper() != c.lower())
    full, initials = [], []
    for raw, dotted in found:
        word = re.sub(r"[’'`‐-―]", lambda m: "-" if m.group(0) not in "’'`" else "", fold(raw))
        if any(c.isdigit() for c in word):
            if not any(c.isalpha() for c in word):
                continue
            word = word.translate(_LOOKS)
        word = "-".join(filter(None, word.split("-")))
        bare = word.replace("-", "")
        if not bare or bare in TITLES or (bare in FILLERS and len(found) > 2):
            continue
        if len(bare) == 1:
            initials.append(bare)
        elif "-" in word and all(len(p) == 1 for p in word.split("-")):
            initials.extend(bare)
        elif raw.isupper() and (len(bare) == 2 or (len(bare) <= 4 and not shouted)) and len(found) > 1:
            initials.extend(bare)
        else:
            full.append(word)
    return full, initials


def normal_form(full: list[str], initials: list[str]) -> str:
    return " ".join(sorted(w.replace("-", "") for w in full)) + "|" + " ".join(sorted(full)) + "|" + "".join(initials)


def grams(full: list[str], initials: list[str]) -> set[str]:
    out = {"^" + i for i in initials}
    for word in full:
        for part in NICKNAMES.get(word, word).split("-"):
            out.add("^" + part[0])
            s = f"^{part}$"
            out.update(s[i : i + 3] for i in range(len(s) - 2))
    return out


def one_error(a: str, b: str) -> bool:
    """Whether one insertion, deletion, change or swap of neighbours turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _word(a: str, b: str) -> int:
    """0: other words, 1: a typing error apart, 2: a short form, 3: equal."""
    x, y = a.replace("-", ""), b.replace("-", "")
    if x == y:
        return 3
    if len(x) > len(y):
        x, y = y, x
    if NICKNAMES.get(x) == y or NICKNAMES.get(y) == x or (x in NICKNAMES and NICKNAMES[x] == NICKNAMES.get(y)):
        return 2
    if y.startswith(x) and 2 <= len(x) <= len(y) - 3:
        return 2
    if len(y) >= 4 and not (y[:-1] == x and y[-1] in "aoe") and one_error(x, y):
        return 1
    return 0


def compare(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]]) -> float:
    """How sure two parsed names name one person or group: 0 if too little is known, less if they have
    a word of some length in common but contradict each other in others."""
    left, right = [*a[0]], [*b[0]]
    typos = short = equal = longest = 0
    for one, other in ((left, right), (right, left)):  # two words for one hyphened word
        for w in [*one]:
            parts = [v for v in other if v in w.split("-")]
            if "-" in w and len(parts) == len(w.split("-")):
                one.remove(w)
                for v in parts:
                    other.remove(v)
                equal += 1
                longest = max(longest, len(w))
    for grade in (3, 2, 1):
        for w in [*left]:
            for v in right:
                if _word(w, v) == grade:
                    left.remove(w)
                    right.remove(v)
                    typos += grade == 1
                    short += grade == 2
                    equal += grade == 3
                    longest = max(longest, min(len(w), len(v)) if grade != 2 else 0)
                    break
    if longest < 4 or typos > 2:
        return 0.0
    if left and right:
        return CONTRADICTION  # both have a word of their own
    ini_a, ini_b = [*a[1]], [*b[1]]
    by_initial = 0
    for rest, initials in ((left, ini_b), (right, ini_a)):
        for w in [*rest]:
            parts = w.split("-")
            first = next((x for x in (w[0], NICKNAMES.get(w, w)[0]) if x in initials), None)
            if first:
                initials.remove(first)
                for p in parts[1:]:
                    if p[0] in initials:
                        initials.remove(p[0])
                rest.remove(w)
                by_initial += 1
    if left or right:
        return CONTRADICTION
    common = 0
    for i in [*ini_a]:
        if i in ini_b:
            ini_a.remove(i)
            ini_b.remove(i)
            common += 1
    if ini_a and ini_b:
        return CONTRADICTION
    matched = equal + typos + short + by_initial
    if matched + common < 2:
        return 0.0
    dropped = bool(ini_a or ini_b)
    return 0.98 - 0.05 * typos - 0.15 * (typos > 1) - 0.05 * short - 0.25 * min(1, by_initial + (matched < 2)) - 0.1 * dropped


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, vectors = [], []
        for name in batch.column(0).to_pylist():
            full, initials = parse(name)
            forms.append(normal_form(full, initials) if full else None)
            vectors.append(sorted(grams(full, initials)) if full else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), pa.array(vectors, pa.list_(pa.string()))], ["name", "form", "grams"])


def _parsed(form: str) -> tuple[list[str], list[str]]:
    _, full, initials = form.split("|")
    return full.split(), [*initials]


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        score = pa.array([compare(_parsed(p), _parsed(q)) for p, q in zip(x, y)], pa.float64())
        import pyarrow.compute as pc

        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score], ["a", "b", "sure"]).filter(pc.not_equal(score, 0.0))


def _alike_in_gram(table: pa.Table, least: float, columns: int) -> pa.Table:
    """Pairs of at least ``least`` cosine of nodes of two blocks (or one) that hold a gram in their prefix, unless
    their prefixes have an earlier gram in common, which gives the pair already. Grams come in one order everywhere."""
    nothing = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if table.num_rows < 2:
        return nothing
    node, at, block = (table[c].to_numpy() for c in ("node", "at", "block"))
    n, low, high = len(node), table["low"][0].as_py(), table["high"][0].as_py()
    lists = table["ids"].combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    row, ids, w = np.repeat(np.arange(n), lengths), lists.flatten().to_numpy(), table["ws"].combine_chunks().flatten().to_numpy()
    early = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < at[row]
    _, column, held = np.unique(ids, return_inverse=True, return_counts=True)
    some = held[column] > 1  # others have no partner
    row, w, early, column = row[some], w[some], early[some], (np.cumsum(held > 1) - 1)[column[some]]
    kinds = int((held > 1).sum())
    left, right = (np.arange(n),) * 2 if low == high else (np.flatnonzero(block == low), np.flatnonzero(block == high))
    dots = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, kinds, columns):
        now = (column >= start) & (column < start + columns)
        x = np.zeros((n, min(columns, kinds - start)), np.float32)
        # An earlier gram counts 2 on the left, -2 on the right: with one in common, no sum reaches the threshold.
        x[row[now], column[now] - start] = np.where(early[now], 2.0, w[now])
        sign = np.ones(x.shape[1], np.float32)
        sign[column[now & early] - start] = -1
        dots += x[left] @ (x[right] * sign).T
    i, j = np.nonzero(dots >= least - ROUNDING)
    a, b = node[left[i]], node[right[j]]
    if low == high:
        a, b = a[i < j], b[i < j]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def cosine_join(vectors: DataFrame, scratch: Scratch, least: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """All pairs (a < b, each once) of at least ``least`` cosine, up to ``ROUNDING``, and the weighted vectors
    (node, vec: array of (gram, weight)). ``vectors``: node, grams; a node has one row."""
    flat = vectors.select("node", F.explode("grams").alias("gram"))
    total = vectors.count()
    rarity = flat.groupBy("gram").agg(F.count("*").alias("df"))
    weighted = flat.join(rarity, "gram").withColumn("w", F.pow(F.log1p(F.lit(float(total)) / F.greatest("df", F.lit(total * RARE))), F.lit(POWER)))
    run = Window.partitionBy("node").orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("node")
    weighted = weighted.withColumn("square", F.sum(F.col("w") * F.col("w")).over(whole)).withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("w")).over(run), F.lit(0.0)))
    entry = F.struct("df", "gram", (F.col("w") / F.sqrt("square")).alias("w"), (F.col("square") - F.col("before") >= least * least * F.col("square") * 0.999999).alias("prefix"))
    rows = scratch.write(weighted.groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("e")), "grams")
    held = rows.select("node", F.transform("e", lambda x: F.xxhash64(x["gram"])).alias("ids"), F.col("e.w").alias("ws"), F.posexplode("e").alias("at", "x")).where("x.prefix and x.df > 1")
    blocks = F.ceil(F.col("x.df") / HOT)
    held = held.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    held = held.select(F.col("x.gram").alias("gram"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "at", "ids", "ws")
    pairs = held.groupBy("gram", "low", "high").applyInArrow(lambda table: _alike_in_gram(table, least, COLUMNS), "a long, b long")
    return pairs, rows.select("node", F.transform("e", lambda x: F.struct(x["gram"].alias("gram"), x["w"].alias("w"))).alias("vec"))


def _pairs_within(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs (a < b) of nodes with equal ``keys``; the nodes of many are spread. ``rows``: ``keys``, node, and n, the size."""
    salted = rows.withColumn("salts", F.ceil(F.col("n") / HOT))
    left = salted.select(*keys, F.pmod(F.xxhash64("node"), "salts").alias("salt"), F.col("node").alias("a"))
    right = salted.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("node").alias("b"))
    return left.join(right, [*keys, "salt"]).where("a < b").select("a", "b")


def hot_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes that share a hot word and an initial of another part, where some node of that
    word gives the initial alone. Full names are paired too: their contradictions tell whose initial it is,
    so the work for one word and initial grows with the square of its nodes. ``nodes``: node, form."""
    parts = F.split("form", r"\|")
    other = F.create_map(*[F.lit(x) for k, v in NICKNAMES.items() if k[0] != v[0] for x in (k, v[0])])
    named = nodes.select("node", F.array_distinct(F.filter(F.split(parts[1], " "), lambda w: w != "")).alias("full"), F.filter(F.split(parts[2], ""), lambda i: i != "").alias("bare"))
    least = F.lit(max(2.0, nodes.count() * HOT_SHARE))
    words = named.select("node", "full", "bare", F.explode("full").alias("word")).where(F.length("word") >= 4)
    words = words.join(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word"), "word")
    rest = F.filter("full", lambda w: w != F.col("word"))
    told = F.concat(F.transform(rest, lambda w: F.substring(w, 1, 1)), F.filter(F.transform(rest, lambda w: F.element_at(other, w)), lambda i: i.isNotNull()))
    keyed = words.select("node", "word", "bare", F.explode(F.array_distinct(F.concat("bare", told))).alias("initial")).select("node", "word", "initial", F.array_contains("bare", F.col("initial")).alias("alone"))
    sizes = keyed.groupBy("word", "initial").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("alone and n > 1").select("word", "initial", "n")
    return _pairs_within(keyed.drop("alone").join(sizes, ["word", "initial"]), ["word", "initial"]).distinct()


def _cosine(x: str, y: str) -> F.Column:
    weights = F.map_from_entries(F.col(y))
    return F.aggregate(F.col(x), F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.element_at(weights, e["gram"]), F.lit(0.0)))


def average_linkage(edges: DataFrame, scratch: Scratch, least: float = LINKAGE) -> DataFrame:
    """``node``, ``cluster`` of every node of ``edges`` (a, b, s; each pair once); absent pairs have
    similarity 0. Each round merges all pairs of clusters that are each other's nearest; among equal
    averages a hash of the pair decides, the same from both sides."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cluster = scratch.write(nodes.select("node", F.col("node").alias("cluster")), "clusters")
    between = scratch.write(edges.select("a", "b", "s", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")), "between")
    while True:
        scored = between.withColumn("rank", F.struct((F.col("s") / (F.col("na") * F.col("nb"))).alias("avg"), F.xxhash64("a", "b").alias("h"))).where(F.col("rank.avg") >= least)
        ends = scored.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("o")), F.struct(F.col("b").alias("n"), F.col("a").alias("o")))).alias("e"), "rank").select("e.n", "e.o", "rank")
        best = ends.groupBy("n").agg(F.max_by("o", "rank").alias("o"))
        merged = best.alias("x").join(best.alias("y"), (F.col("x.o") == F.col("y.n")) & (F.col("y.o") == F.col("x.n"))).where("x.n > x.o").select(F.col("x.n").alias("old"), F.col("x.o").alias("new"))
        merged = scratch.write(merged, "merged")
        if merged.isEmpty():
            break
        moved = scratch.write(cluster.join(merged, cluster["cluster"] == merged["old"], "left").select("node", F.coalesce("new", "cluster").alias("cluster")), "clusters")
        sizes = moved.groupBy("cluster").agg(F.count("*").alias("n"))
        step = between.join(merged.select(F.col("old").alias("a"), F.col("new").alias("ra")), "a", "left").join(merged.select(F.col("old").alias("b"), F.col("new").alias("rb")), "b", "left")
        step = step.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"), "s").where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s"))
        step = step.join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "s", "na", "nb")
        after = scratch.write(step, "between")
        for old in (cluster, between, merged):
            scratch.drop(old)
        cluster, between = moved, after
    return cluster


def _compared(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """``a``, ``b``, ``sure`` of the pairs whose comparison is not 0."""
    named = pairs.join(forms.select(F.col("node").alias("a"), F.col("form").alias("x")), "a").join(forms.select(F.col("node").alias("b"), F.col("form").alias("y")), "b")
    return named.select("a", "b", "x", "y").mapInArrow(_compare_batches, "a long, b long, sure double")


def link_names(lists: DataFrame, names_col: str = "authors", least: float = LINKAGE, top_n: int | None = None) -> DataFrame:
    """``name`` (every distinct string of the arrays in ``names_col``), ``entity`` (the same for all
    spellings of one person or group), ``n_rows`` (times it occurs) and ``links`` (other normal forms
    it was found similar to).

    Null arrays and null names are left out. Blank names and names without letters have an entity
    of their own each. Repeated rows add to ``n_rows``; empty tables give no rows."""
    scratch = Scratch(lists.sparkSession)
    names = lists.select(F.explode(F.col(names_col)).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n_rows"))
    # A handful of rows per task would waste Python workers, a huge list must not sit in one: hash by name.
    parsed = names.select("name").mapInArrow(_parse_batches, "name string, form string, grams array<string>")
    parsed = parsed.join(names, "name").withColumn("node", F.xxhash64(F.coalesce("form", F.concat(F.lit("\u0001"), "name"))))
    parsed = scratch.write(parsed, "parsed")
    nodes = parsed.where("form is not null").groupBy("node").agg(F.min("form").alias("form"), F.first("grams").alias("grams"), F.sum("n_rows").alias("weight"))
    nodes = scratch.write(nodes, "nodes")
    pairs, vectors = cosine_join(nodes.select("node", "grams"), scratch)
    forms = nodes.select("node", "form", "weight")
    hot = scratch.write(hot_pairs(nodes), "hot")
    sure = scratch.write(_compared(pairs.union(hot).distinct(), forms).where("sure > 0"), "sure")
    scored = (
        sure.join(vectors.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a")
        .join(vectors.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b")
        .withColumn("cosine", _cosine("x", "y"))
        .join(hot.withColumn("hot", F.lit(True)), ["a", "b"], "left")
        .where((F.col("cosine") >= COSINE) | F.col("hot"))
        .select("a", "b", (F.col("sure") + 0.02 * F.col("cosine")).alias("s"))
    )
    if top_n is not None:
        ends = scored.select("*", F.explode(F.array("a", "b")).alias("n"))
        rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("s"), "a", "b"))
        scored = ends.withColumn("r", rank).where(F.col("r") <= top_n).select("a", "b", "s").distinct()
    scored = scratch.write(scored, "scored")
    # Contradictions matter only between names that links connect; there all of them count, whatever their cosine.
    linked = scratch.write(connected_components(scored), "linked")
    linked = linked.join(linked.groupBy("component").agg(F.count("*").alias("n")).where("n > 2"), "component")
    against = _compared(_pairs_within(linked, ["component"]), forms).where("sure < 0").select("a", "b", F.col("sure").alias("s"))
    clusters = average_linkage(scored.union(against), scratch, least)
    degree = scored.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    out = parsed.join(clusters, "node", "left").join(degree, "node", "left")
    return out.select("name", F.coalesce("cluster", "node").alias("entity"), "n_rows", F.coalesce("links", F.lit(0)).alias("links"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of different strings of one entity, smaller first, as TESTDATA.md asks for."""
    shared = linked.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    some = linked.select("name", "entity").join(shared, "entity", "left_semi")
    other = some.select(F.col("name").alias("name_b"), "entity")
    return some.join(other, "entity").where("name < name_b").select(F.col("name").alias("name_a"), "name_b")
