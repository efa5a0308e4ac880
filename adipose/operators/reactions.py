"""Reactions: selection, links to lipids, edges, chains.

A reaction row is (reaction_ord, reaction_id, reaction_name, type, reactants, products, genes, proteins,
curations, pathways); ``participants`` explodes it to one row a compound.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import lists_in_parts, spread, stored
from ..functions.text import filled
from ..sources.reference_tables import display_name
from .joins import BROADCAST_ROWS, reference_join

# fixed value: the type of a main compound
MAIN = "lm_main"


def participants(reactions: DataFrame) -> DataFrame:
    """(reaction_ord, reaction_id, reaction_name, role, pos, compound): reactants before products; one read of ``reactions``."""
    side = lambda c, role: F.struct(F.lit(role).alias("role"), F.col(c).alias("compounds"))
    sides = reactions.select("reaction_ord", "reaction_id", "reaction_name", F.explode(F.array(side("reactants", "reactant"), side("products", "product"))).alias("side"))
    return sides.select("reaction_ord", "reaction_id", "reaction_name", "side.role", F.posexplode("side.compounds").alias("pos", "compound"))


def touching(reactions: DataFrame, ids: DataFrame) -> DataFrame:
    """The reactions any of whose participants has one of ``ids`` (lm_id)."""
    wanted = ids.where("lm_id <> ''").select("lm_id").distinct()
    hit = participants(reactions).select("reaction_ord", F.col("compound.compound_lm_id").alias("lm_id")).join(wanted, "lm_id", "left_semi")
    return reactions.join(hit.select("reaction_ord").distinct(), "reaction_ord", "left_semi")


def _main(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array()), lambda x: F.coalesce(x["compound_type"] == MAIN, F.lit(False)))


def has_main_components(c: tuple[str, str] = ("reactants", "products")) -> Column:
    return F.size(F.concat(_main(c[0]), _main(c[1]))) > 0


def side_name(c: Column) -> Column:
    return F.array_join(F.transform(c, display_name), "; ")


def keep_main(reactions: DataFrame) -> DataFrame:
    """Main reactants and products only, with a rebuilt name; reactions left with neither go."""
    cut = reactions.withColumn("reactants", _main("reactants")).withColumn("products", _main("products"))
    kept = cut.where((F.size("reactants") > 0) | (F.size("products") > 0))
    return kept.withColumn("reaction_name", F.concat(side_name(F.col("reactants")), F.lit(" -> "), side_name(F.col("products"))))


_DETAILS = ["reaction_id", "reaction_name", "reactants", "products", "genes", "proteins", "curations", "pathways", "type", "enzyme_ids", "pathway_ids"]


def reaction_links(reactions: DataFrame, ids: DataFrame, details: bool = False) -> DataFrame:
    """(lm_id, reaction_ord, reaction_id, reaction_name, type, enzyme_ids, pathway_ids, role, pos): one a participant with one of ``ids``.

    Kept at the level of ids; ``lipid_reactions`` expands it to lipid rows late, since many rows can
    share an id and an id many reactions. ``details`` adds the whole reaction as JSON text. The links are
    written once, since what follows reads them several times; ``reactions`` is read twice.
    """
    listed = lambda c: F.col(c).cast("array<string>") if c in reactions.columns else F.lit(None).cast("array<string>")
    kind = F.coalesce(filled(F.col("type")), F.lit("species-level")) if "type" in reactions.columns else F.lit("species-level")
    ids = ids.where("lm_id <> ''").select("lm_id").distinct()
    each = stored(participants(reactions).select(F.col("compound.compound_lm_id").alias("lm_id"), "reaction_ord", "role", "pos").join(ids, "lm_id", "left_semi"), "participants")
    # only reactions with a link are moved and written as text
    hit = stored(each.select("reaction_ord").distinct(), "linked-reactions")
    linked = reactions.join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, "reaction_ord", "left_semi")
    whole = [F.to_json(F.struct(*[c for c in _DETAILS if c in reactions.columns])).alias("details")] if details else []
    about = linked.select(
        "reaction_ord", F.coalesce(F.col("reaction_id").cast("string"), F.lit("")).alias("reaction_id"), F.coalesce("reaction_name", F.lit("")).alias("reaction_name"),
        kind.alias("type"), listed("enzyme_ids").alias("enzyme_ids"), listed("pathway_ids").alias("pathway_ids"), *whole,
    )
    return stored(each.join(about, "reaction_ord").select("lm_id", *about.columns[:6], "role", "pos", *about.columns[6:]), "links")


def lipid_reactions(lipids: DataFrame, links: DataFrame) -> DataFrame:
    """A row per lipid row and link; an id that very many lipids share is no one task's, nor are all lipids of a small file."""
    return reference_join(spread(lipids.select("row_idx", "input_name", "lm_id")), links, "lm_id", "inner")


def nested_reactions(lipids: DataFrame, links: DataFrame) -> DataFrame:
    """``lipids`` with the list of their links in order; empty without match, null without id."""
    order = F.struct("reaction_ord", (F.col("role") == "product").alias("second"), "pos", "reaction_id", "reaction_name", "type", "enzyme_ids", "pathway_ids", "role", *["details"][: "details" in links.columns])
    lists = links.groupBy("lm_id").agg(F.array_sort(F.collect_list(order)).alias("reactions"))
    empty = F.array().cast(lists.schema["reactions"].dataType)
    return lipids.join(lists, "lm_id", "left").withColumn("reactions", F.when(F.coalesce("lm_id", F.lit("")) != "", F.coalesce("reactions", empty)))


#: Links in one part of an id's list.
LIST_PART = 10_000


def link_parts(links: DataFrame, size: int = LIST_PART) -> DataFrame:
    """(lm_id, part, reactions): the list that ``nested_reactions`` gives for an id, in parts of at most ``size`` links.

    A hub's list is many bounded rows; lipid rows meet them by id when they are asked for.
    """
    each = links.withColumn("second", F.col("role") == "product")
    return lists_in_parts(each, ["lm_id"], ["reaction_ord", "second", "pos", "reaction_id"], size, "reactions")


def edges(reactions: DataFrame) -> DataFrame:
    """(src, dst, reaction_id, reaction_name): every reactant with every product; the last reaction of a pair counts."""
    named = reactions.select("reaction_ord", "reaction_id", "reaction_name", F.transform("reactants", display_name).alias("from"), F.transform("products", display_name).alias("to"))
    pairs = named.select("reaction_ord", "reaction_id", "reaction_name", F.explode("from").alias("src"), "to").withColumn("dst", F.explode("to"))
    return pairs.groupBy("src", "dst").agg(F.max_by(F.struct("reaction_id", "reaction_name"), "reaction_ord").alias("last")).select("src", "dst", "last.*")


def graph_size(edge_table: DataFrame) -> DataFrame:
    """(nodes, edges), the edges being read once: an edge is listed under its source and its target."""
    ends = edge_table.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("edge")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("edge")))).alias("end")).select("end.*")
    per_node = ends.groupBy("id").agg(F.sum("edge").alias("edges"))
    return per_node.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))


def complete_reactions(reactions: DataFrame, ids: DataFrame, complete: bool = True) -> DataFrame:
    """Reactions all of whose participants with an id were observed; else those with any."""
    seen = ids.where("lm_id <> ''").select("lm_id").distinct().withColumn("observed", F.lit(True))
    asked = participants(reactions).select("reaction_ord", filled(F.col("compound.compound_lm_id")).alias("lm_id")).where("lm_id is not null")
    state = asked.join(seen, "lm_id", "left").groupBy("reaction_ord").agg(F.bool_and(F.coalesce("observed", F.lit(False))).alias("all"), F.bool_or(F.coalesce("observed", F.lit(False))).alias("any"))
    return reactions.join(state.where(F.col("all" if complete else "any")).select("reaction_ord"), "reaction_ord", "left_semi")


def component_lipids(reactions: DataFrame, lipids: DataFrame) -> DataFrame:
    """(reaction_ord, role, pos, lm_id, row_idx): the observed lipids of each component."""
    each = stored(participants(reactions).select("reaction_ord", "role", "pos", F.col("compound.compound_lm_id").alias("lm_id")), "participants")
    return reference_join(each, lipids.where("lm_id <> ''").select("lm_id", "row_idx"), "lm_id", "inner").select("reaction_ord", "role", "pos", "lm_id", "row_idx")


def component_quantities(reactions: DataFrame, lipids: DataFrame, quant: DataFrame) -> DataFrame:
    """(reaction_ord, role, lm_id, sample_id, value): summed over a component's lipids.

    Values are summed per id and sample first, then joined to the reactions, so that a compound of
    many reactions is added up once.
    """
    per_id = lipids.where("lm_id <> ''").select("lm_id", "row_idx").join(quant.select("row_idx", "sample_id", "value"), "row_idx").groupBy("lm_id", "sample_id").agg(F.sum("value").alias("value"))
    each = participants(reactions).select("reaction_ord", "role", F.col("compound.compound_lm_id").alias("lm_id")).distinct()
    return each.join(per_id, "lm_id").select("reaction_ord", "role", "lm_id", "sample_id", "value")


def _sides(reactions: DataFrame) -> DataFrame:
    return participants(reactions).select("reaction_ord", "role", filled(F.col("compound.compound_lm_id")).alias("lm_id")).where("lm_id is not null").distinct()


def compound_links(reactions: DataFrame) -> DataFrame:
    """(lm_id, producers, consumers, links): the compounds that link reactions, and how many pairs of reactions each links.

    One row a compound, counted before the shuffle: a hub makes producers x consumers links, which are
    counted here and listed by ``next_reactions`` only on request. ``links`` leaves out a reaction with itself.
    """
    sides = _sides(reactions)
    both = sides.groupBy("reaction_ord", "lm_id").agg((F.count(F.lit(1)) == 2).alias("loop"), F.min("role").alias("role"))
    made, used = F.count_if(F.col("loop") | (F.col("role") == "product")), F.count_if(F.col("loop") | (F.col("role") == "reactant"))
    counts = both.groupBy("lm_id").agg(made.alias("producers"), used.alias("consumers"), F.count_if("loop").alias("loops"))
    return counts.where("producers > 0 and consumers > 0").select("lm_id", "producers", "consumers", (F.col("producers") * F.col("consumers") - F.col("loops")).alias("links"))


#: Producers of one compound go to as many parts of about this size; its consumers are copied to each part.
HUB = 1000


def next_reactions(reactions: DataFrame) -> DataFrame:
    """(src, dst): reaction ``dst`` takes a product of reaction ``src``; ids shared twice count once.

    A hub's producers are dealt over parts, so that no task makes all of its links. Only a pair that may
    share a further compound can come twice: these pairs, told by a 64-bit mask of each side's other
    compounds, are made distinct, and all others are made once and not shuffled.
    """
    sides = stored(_marked(_sides(reactions)), "sides")
    made = sides.where("role = 'product'").select(F.col("reaction_ord").alias("src"), "lm_id", F.col("others").alias("made"))
    used = sides.where("role = 'reactant'").select(F.col("reaction_ord").alias("dst"), "lm_id", F.col("others").alias("used"))
    hubs = stored(made.groupBy("lm_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB).select("lm_id", F.ceil(F.col("n") / HUB).cast("int").alias("parts")), "hubs")
    hubs = F.broadcast(hubs) if hubs.count() <= BROADCAST_ROWS else hubs
    parts = F.coalesce("parts", F.lit(1))
    dealt = made.join(hubs, "lm_id", "left").select("src", "lm_id", "made", F.pmod(F.xxhash64("src"), parts).cast("int").alias("part"))
    copied = used.join(hubs, "lm_id", "left").select("dst", "lm_id", "used", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = dealt.join(copied, ["lm_id", "part"]).where("src <> dst")
    again = F.col("made").bitwiseAND(F.col("used")) != 0
    return pairs.where(~again).select("src", "dst").unionByName(pairs.where(again).select("src", "dst").distinct())


def _marked(sides: DataFrame) -> DataFrame:
    """``sides`` with ``others``: a mask with a bit of each other compound on the same side of the reaction."""
    place = F.pmod(F.xxhash64("lm_id"), F.lit(64)).cast("int")
    bit, side = F.expr("shiftleft(1L, place)"), ["reaction_ord", "role"]
    all_ = sides.withColumn("place", place).withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy(*side, "place"))).withColumn("all", F.bit_or(bit).over(Window.partitionBy(*side)))
    return all_.select(*sides.columns, F.when(F.col("alike") > 1, F.col("all")).otherwise(F.col("all").bitwiseXOR(bit)).alias("others"))


_COUNT = "decimal(38,0)"


def walk_counts(reactions: DataFrame, hops: int, within: DataFrame | None = None) -> DataFrame:
    """(hops, reaction_ord, walks): how many chains of 1 to ``hops`` steps end at each reaction.

    A step goes from a reaction over one of its products to another reaction that takes it, so two
    shared compounds are two steps. Each level is two sums, by compound and by reaction, of the
    level before; no link is listed, and what a level moves is as long as the participants. A chain may
    come back to a reaction it has met; with ``within`` (reaction_ord), such as the reactions outside
    ``cycle_core``, only chains over these are counted, and outside the core none comes back.
    """
    sides = _sides(reactions)
    sides = stored(sides if within is None else sides.join(within.select("reaction_ord").distinct(), "reaction_ord", "left_semi"), "sides")
    made, used = (sides.where(F.col("role") == r).select("reaction_ord", "lm_id") for r in ("product", "reactant"))
    loops = _loops(made, used)
    level = sides.select("reaction_ord").distinct().withColumn("n", F.lit(1).cast(_COUNT))
    levels = []
    for hop in range(1, hops + 1):
        level = _step(level, made, used, loops)
        levels.append(level.select(F.lit(hop).alias("hops"), "reaction_ord", F.col("n").alias("walks")))
    return functools.reduce(DataFrame.unionByName, levels)


def _loops(made: DataFrame, used: DataFrame) -> DataFrame:
    """(reaction_ord, loops): the compounds that a reaction would hand to itself."""
    return stored(made.join(used, ["reaction_ord", "lm_id"]).groupBy("reaction_ord").agg(F.count(F.lit(1)).cast(_COUNT).alias("loops")), "loops")


def _step(level: DataFrame, near: DataFrame, far: DataFrame, loops: DataFrame, *less: DataFrame) -> DataFrame:
    """(reaction_ord, n): ``level`` (reaction_ord, n) summed over one step from the reactions of ``near`` to those of ``far``, without steps to itself; rows of ``less`` are taken off.

    What is taken off goes into the one sum by reaction as negative terms. The sums by compound are
    written, so that a hub's rows come right from their shuffle and are split by the skew join.
    """
    over = stored(near.join(level, "reaction_ord").groupBy("lm_id").agg(F.sum("n").cast(_COUNT).alias("n")), "compound-sums")
    own = level.join(loops, "reaction_ord").select("reaction_ord", (F.col("n") * F.col("loops")).alias("n"))
    terms = far.join(F.broadcast(over) if over.count() <= BROADCAST_ROWS else over, "lm_id").select("reaction_ord", "n")
    for off in (own, *less):
        terms = terms.unionByName(off.select("reaction_ord", (-F.col("n")).cast(_COUNT).alias("n")))
    return stored(terms.groupBy("reaction_ord").agg(F.sum("n").cast(_COUNT).alias("n")).where("n > 0"), "level")


def cycle_core(reactions: DataFrame) -> DataFrame:
    """(reaction_ord) of what is left when reactions without a predecessor or without a successor are taken off again and again.

    Every reaction on a cycle is in it, so chains outside meet no reaction twice. Each round counts
    makers and takers per compound; it ends when a round takes nothing off.
    """
    pairs = _sides(reactions).groupBy("reaction_ord", "lm_id").agg(F.max((F.col("role") == "product").cast("int")).alias("makes"), F.max((F.col("role") == "reactant").cast("int")).alias("takes"))
    pairs, n = stored(pairs, "core"), -1
    while True:
        ends = pairs.groupBy("lm_id").agg(F.sum("makes").alias("makers"), F.sum("takes").alias("takers"))
        seen = reference_join(pairs, ends, "lm_id", "inner")
        before = (F.col("takes") == 1) & (F.col("makers") > F.col("makes"))
        after = (F.col("makes") == 1) & (F.col("takers") > F.col("takes"))
        kept = stored(seen.groupBy("reaction_ord").agg(F.bool_or(before).alias("before"), F.bool_or(after).alias("after")).where("before and after").select("reaction_ord"), "core")
        left = kept.count()
        if left in (n, 0):
            return kept
        pairs, n = stored(pairs.join(kept, "reaction_ord", "left_semi"), "core"), left


def chains_from(reactions: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(path, hops): the chains of ``chains`` that begin at ``starts`` (reaction_ord); other links are not listed."""
    sides = stored(_sides(reactions), "sides")
    made = sides.where("role = 'product'").select(F.col("reaction_ord").alias("src"), "lm_id")
    used = sides.where("role = 'reactant'").select(F.col("reaction_ord").alias("dst"), "lm_id")
    frontier = starts.select(F.array("reaction_ord").alias("path")).distinct()
    levels = []
    for _ in range(hops):
        over = frontier.withColumn("src", F.element_at("path", -1)).join(made, "src").select("path", "lm_id")
        ahead = reference_join(over, used, "lm_id", "inner").where(~F.array_contains("path", F.col("dst")))
        frontier = stored(ahead.select(F.concat("path", F.array("dst")).alias("path")).distinct(), "chains")
        levels.append(frontier)
    return functools.reduce(DataFrame.unionByName, levels).withColumn("hops", F.size("path") - 1)


def chain_counts(reactions: DataFrame) -> DataFrame:
    """(hops, reaction_ord, chains): how many of the ``chains`` of one and of two steps begin at each reaction.

    None is listed. Steps over each compound are counted as in ``walk_counts``; then a pair of reactions
    that shares several compounds is counted once, and ways back to the start are taken off. Both
    corrections list only the pairs concerned, found over two compounds at a time, so they grow with the
    squares of single reactions' participants and not with a compound's producers x consumers.
    """
    sides = stored(_sides(reactions), "sides")
    made, used = (sides.where(F.col("role") == r).select("reaction_ord", "lm_id") for r in ("product", "reactant"))
    two = lambda a, b: a.withColumnRenamed("lm_id", "a").join(b.withColumnRenamed("lm_id", "b"), "reaction_ord")
    src, dst = F.col("reaction_ord").alias("src"), F.col("reaction_ord").alias("dst")
    # k shared compounds make k (k - 1) / 2 rows
    shared = two(made, made).where("a < b").select(src, "a", "b").join(two(used, used).where("a < b").select(dst, "a", "b"), ["a", "b"]).where("src <> dst")
    extra = stored(shared.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).select("src", "dst", F.round((F.sqrt(8 * F.col("n") + 1) - 1) / 2).cast(_COUNT).alias("extra")), "shared-twice")
    both = two(made, used)
    back = both.select(src, "a", "b").join(both.select(dst, F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("src <> dst").select("src", "dst").distinct()
    back = stored(back.groupBy(F.col("src").alias("reaction_ord")).agg(F.count(F.lit(1)).cast(_COUNT).alias("n")), "ways-back")
    loops = _loops(made, used)
    again = lambda level: extra.join(level.withColumnRenamed("reaction_ord", "dst"), "dst").select(F.col("src").alias("reaction_ord"), (F.col("n") * F.col("extra")).alias("n"))
    none = sides.select("reaction_ord").distinct().withColumn("n", F.lit(1).cast(_COUNT))
    one = _step(none, used, made, loops, again(none))
    two_steps = _step(one, used, made, loops, again(one), back)
    return one.select(F.lit(1).alias("hops"), "reaction_ord", F.col("n").alias("chains")).unionByName(two_steps.select(F.lit(2).alias("hops"), "reaction_ord", F.col("n").alias("chains")))


def chains(reactions: DataFrame, hops: int) -> DataFrame:
    """(path, hops): chains of up to ``hops`` steps that meet no reaction twice.

    Each hop is a join of the frontier with the one-hop table, which is checkpointed once.
    """
    spark = reactions.sparkSession
    step = next_reactions(reactions)
    if spark.conf.get("spark.checkpoint.dir", None):
        step = step.checkpoint()
    found = frontier = step.select(F.array("src", "dst").alias("path"))
    for _ in range(hops - 1):
        ahead = frontier.withColumn("src", F.element_at("path", -1)).join(step, "src").where(~F.array_contains("path", F.col("dst")))
        frontier = ahead.select(F.concat("path", F.array("dst")).alias("path"))
        if spark.conf.get("spark.checkpoint.dir", None):
            frontier = frontier.checkpoint()
        found = found.unionByName(frontier)
    return found.withColumn("hops", F.size("path") - 1)
