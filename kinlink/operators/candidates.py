"""Candidate generation: equi-blocks, trigram or token similarity inside them, top k per query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink import constants as K
from kinlink.functions import similarity as S
from kinlink.functions.rules import department_of
from kinlink.functions.text import or_blank
from kinlink.operators.setjoin import TEXT_CODE, TRIGRAM_CODE, best_by_words, best_in_cells, encoded_sets, pairs_in_blocks
from kinlink.session import cut

#: Pairs of strings a task compares, about a second of work, and the most tasks of one such join.
PAIRS_PER_TASK, MOST_TASKS = 250_000, 20_000


def active_only(registry: DataFrame, state: str = "etat_administratif") -> DataFrame:
    return registry.filter(F.col(state) == "A")


def top_k_per_entity(df: DataFrame, entity: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per entity. Spark prunes to k rows per map task before the shuffle."""
    w = Window.partitionBy(*entity).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _reference_strings(registry: DataFrame, blocks: dict[str, str], texts: list[str], key: str, k: int) -> DataFrame:
    """Distinct strings per block with their k smallest ids.

    More ids of one string can never be among the k best of any query, because k smaller ids rank before them with at
    least the same similarity. A string shared by a third of the registry therefore shrinks to k ids map-side.
    """
    strings = registry.select(
        key,
        *[F.col(c).alias(b) for b, c in blocks.items()],
        F.explode(F.array_distinct(F.array(*[or_blank(F.col(t)) for t in texts]))).alias("ref_text"),
    ).filter(F.col("ref_text") != "")
    group = [*blocks, "ref_text"]
    first = top_k_per_entity(strings, group, [F.col(key)], k)
    return first.groupBy(*group).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def _best_ids(pairs: DataFrame, texts: int, key: str, k: int) -> DataFrame:
    """The k best ids per query string: ``q_id``, ``key``, ``sim`` and ``rank``."""
    # An id shows up once per text, so the first k * texts rows hold the k best ids; the rest is done in place.
    order = [F.desc("sim"), F.col(key)]
    hits = top_k_per_entity(pairs, ["q_id"], order, k * texts, "__row")
    if texts > 1:
        hits = top_k_per_entity(hits, ["q_id", key], [F.desc("sim")], 1, "__copy")
    return top_k_per_entity(hits, ["q_id"], order, k).select("q_id", key, "sim", "rank")


def _block_sizes(strings: DataFrame, refs: DataFrame, blocks: list[str], most_pairs: int) -> DataFrame:
    """One row per block both sides have, with its ``pairs`` of strings and ``small``: are they at most ``most_pairs``?"""
    n = lambda side, name: side.groupBy(*blocks).agg(F.count("*").alias(name))
    both = n(strings, "__q").join(n(refs, "__r"), blocks)
    pairs = F.col("__q") * F.col("__r")
    return both.select(*blocks, pairs.alias("pairs"), (pairs <= most_pairs).alias("small"))


def similar_candidates(
    queries: DataFrame,
    registry: DataFrame,
    *,
    query_id: list[str],
    query: str,
    query_blocks: dict[str, str],
    texts: list[str],
    ref_blocks: dict[str, str],
    key: str = "siret",
    k: int = 10,
    threshold: float = K.TRIGRAM_THRESHOLD,
    tokens=S.trigrams,
    score: Column | None = None,
    most_pairs: int = 1_000_000,
    short: int = 1000,
) -> DataFrame:
    """The k most similar registry ids per query row, in columns (query_id, key, sim, rank).

    Queries and references meet as distinct strings per block. ``query_blocks`` and ``ref_blocks`` map the same block
    names to each side's columns. An id scores by the better of its ``texts``; ties go to the smaller id. ``score``
    replaces the Jaccard similarity as the ranking value; it has to rank by ``shared``, the shared token count, and then by
    ``sim``, and needs a threshold that any shared token passes.

    A block of at most ``most_pairs`` pairs of distinct strings is compared pair by pair, which is less work than token
    lists there; larger blocks go through cells that count shared tokens in place, or with ``score`` through the word search,
    which reads the first ``short`` references of a list before the others. All give the same rows.
    """
    blocks = list(query_blocks)
    asked = queries.select(
        *query_id, F.col(query).alias("query_text"), *[F.col(c).alias(b) for b, c in query_blocks.items()]
    )
    asked = asked.filter(or_blank(F.col("query_text")) != "")
    code = TRIGRAM_CODE if tokens is S.trigrams else TEXT_CODE
    strings = asked.select(*blocks, "query_text").distinct().withColumn("tokens", tokens(F.col("query_text")))
    refs = _reference_strings(registry, ref_blocks, texts, key, k).withColumn("tokens", tokens(F.col("ref_text"))).drop("ref_text")
    strings = encoded_sets(strings, "tokens", code, "q_id", "strings")
    refs = encoded_sets(refs.withColumn("order", F.col("ids")[0]), "tokens", code, "r_id", "references")
    sizes = cut(_block_sizes(strings, refs, blocks, most_pairs), "blocks")
    value = (F.col("sim") if score is None else score).alias("sim")
    hits = lambda pairs: pairs.join(refs.select("r_id", "ids"), "r_id").select("q_id", value, F.explode("ids").alias(key))
    ranked = lambda pairs: _best_ids(hits(pairs), len(texts), key, k)
    # Partitions by work, not by bytes; both sides are dealt alike, so the join needs no other exchange.
    work = sizes.filter("small").agg(F.sum("pairs")).first()[0] or 0
    tasks = min(max(1, work // PAIRS_PER_TASK), MOST_TASKS)
    in_small = lambda side: side.join(sizes.filter("small").select(*blocks), blocks).repartition(tasks, *blocks)
    best = ranked(pairs_in_blocks(in_small(strings), in_small(refs), blocks, threshold))
    large = sizes.filter("NOT small").select(*blocks)
    if not large.isEmpty():
        left, others = cut(strings.join(large, blocks), "open"), cut(refs.join(large, blocks), "open-references")
        if score is not None:
            found = best_by_words(left, others, blocks, k * len(texts), short)
        else:
            found = best_in_cells(left, others, blocks, k * len(texts), threshold)
        best = best.unionByName(ranked(found))
    numbers = strings.select(*blocks, "query_text", "q_id")
    return asked.join(numbers, [*blocks, "query_text"]).join(best, "q_id").select(*query_id, key, "sim", "rank")


def name_candidates(
    variants: DataFrame,
    registry: DataFrame,
    *,
    by: tuple[str, str] = ("code_postal", "code_postal"),
    query_id: tuple[str, ...] = ("prospect_id", "variant_pos"),
    query: str = "variant",
    texts: tuple[str, ...] = ("denomination_clean", "enseigne_clean"),
    key: str = "siret",
    k: int = 10,
    threshold: float = K.TRIGRAM_THRESHOLD,
    **options,
) -> DataFrame:
    """Fuzzy name search in one block, postcode by default, on either of two name columns."""
    return similar_candidates(
        variants, registry, query_id=list(query_id), query=query, query_blocks={"block": by[0]},
        texts=list(texts), ref_blocks={"block": by[1]}, key=key, k=k, threshold=threshold,
        **options,
    )


def name_candidates_with_fallback(
    variants: DataFrame, registry: DataFrame, *, department: str = "departement", **options
) -> DataFrame:
    """Postcode search; the department only for (prospect, variant) rows the postcode gave nothing for."""
    query_id = list(options.get("query_id", ("prospect_id", "variant_pos")))
    near = cut(name_candidates(variants, registry, **options), "near")
    empty = variants.join(near.select(*query_id).distinct(), query_id, "left_anti")
    empty = empty.filter(or_blank(F.col(department)) != "")
    far = name_candidates(empty, registry, by=(department, department), **options)
    return near.withColumn("block_kind", F.lit("postcode")).unionByName(far.withColumn("block_kind", F.lit("department")))


def in_asked_departments(
    registry: DataFrame, asked: DataFrame, *, postcode: str = "code_postal", department: str = "departement",
    own: str | None = None, also: tuple[str, ...] = (), corsica: str = "full", most: int = 1_000,
) -> DataFrame:
    """The registry's departments in which the asked postcodes lie, so that a search by postcode reads only their folders.

    For a registry whose department follows from the postcode, as ``build_registry`` writes it. ``own`` names a column of
    ``asked`` with departments to search as well, ``also`` lists others. The departments come to the driver as a filter on
    the partition column; beyond ``most`` values the registry stays whole.
    """
    places = F.array(department_of(F.col(postcode), corsica), F.col(own) if own else F.lit(None).cast("string"))
    codes = {r.d for r in asked.select(F.explode(places).alias("d")).distinct().limit(most + 1).collect()}
    return registry if len(codes) > most else registry.filter(F.col(department).isin(sorted({*codes, *also} - {None})))


def address_candidates(
    prospects: DataFrame,
    registry: DataFrame,
    *,
    query_id: tuple[str, ...] = ("prospect_id",),
    number: tuple[str, str] = ("adresse_numero", "numero_voie"),
    street: tuple[str, str] = ("adresse_voie_clean", "voie_clean"),
    postcode: tuple[str, str] = ("code_postal", "code_postal"),
    key: str = "siret",
    k: int = 10,
    threshold: float = K.TRIGRAM_THRESHOLD,
) -> DataFrame:
    """Equal postcode and street number, similar street."""
    known = prospects.filter(or_blank(F.col(number[0])) != "")
    return similar_candidates(
        known, registry, query_id=list(query_id), query=street[0],
        query_blocks={"block": postcode[0], "block_number": number[0]}, texts=[street[1]],
        ref_blocks={"block": postcode[1], "block_number": number[1]}, key=key, k=k, threshold=threshold,
    )


def street_candidates(
    prospects: DataFrame,
    registry: DataFrame,
    *,
    query_id: tuple[str, ...] = ("prospect_id",),
    street: tuple[str, str] = ("adresse_voie_clean", "voie_clean"),
    postcode: tuple[str, str] = ("code_postal", "code_postal"),
    key: str = "siret",
    k: int = 5,
    threshold: float = K.TRIGRAM_THRESHOLD,
) -> DataFrame:
    """Similar street in the postcode, whatever the number."""
    return similar_candidates(
        prospects, registry, query_id=list(query_id), query=street[0], query_blocks={"block": postcode[0]},
        texts=[street[1]], ref_blocks={"block": postcode[1]}, key=key, k=k, threshold=threshold,
    )


def nearby_postcodes(df: DataFrame, postcode: str = "code_postal", table: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per alternative postcode of the prospect's three-digit prefix, with its turn ``alt_ord``."""
    table = K.NEARBY_POSTCODES if table is None else table
    entries = F.create_map(*[x for p, alts in table.items() for x in (F.lit(p), F.array(*map(F.lit, alts)))])
    alternatives = F.filter(F.element_at(entries, F.substring(postcode, 1, 3)), lambda a: a != F.col(postcode))
    return df.select("*", F.posexplode(alternatives).alias("alt_ord", "alt_postcode"))


def nearby_address_candidates(
    prospects: DataFrame,
    registry: DataFrame,
    *,
    query_id: str = "prospect_id",
    department: str = "departement",
    departments: tuple[str, ...] = tuple(K.NEARBY_DEPARTMENTS),
    table: dict[str, list[str]] | None = None,
    **options,
) -> DataFrame:
    """Address search in neighbouring postcodes: the first one that has any row wins.

    One search a turn, of the prospects without a hit so far; it ends when there are none or they have no more turns. There
    are as many turns as the longest list of the table, a handful.
    """
    number = options.get("number", ("adresse_numero", "numero_voie"))[0]
    asked = prospects.filter(F.col(department).isin(*departments) & (or_blank(F.col(number)) != ""))
    turns = cut(nearby_postcodes(asked, table=table), "turns")

    def search(rest: DataFrame) -> DataFrame:
        return address_candidates(
            rest, registry, query_id=(query_id, "alt_ord"), postcode=("alt_postcode", "code_postal"), **options
        )

    found, turn, rest = [], 0, turns.filter("alt_ord = 0")
    while not rest.isEmpty():
        found.append(cut(search(rest), f"turn{turn}"))
        turns = turns.join(found[-1].select(query_id).distinct(), query_id, "left_anti")
        turn += 1
        rest = turns.filter(F.col("alt_ord") == turn)
    return reduce(DataFrame.unionByName, found) if found else search(rest)


def name_search(
    variants: DataFrame,
    registry: DataFrame,
    *,
    by: tuple[str, str] = ("code_postal", "code_postal"),
    query_id: tuple[str, ...] = ("prospect_id", "variant_pos"),
    query: str = "variant",
    texts: tuple[str, ...] = ("denomination_clean", "enseigne_clean"),
    key: str = "siret",
    k: int = 5,
    **options,
) -> DataFrame:
    """Search by whole words in one block: ids that share a word, ranked by shared words, word-set similarity, id."""
    return similar_candidates(
        variants, registry, query_id=list(query_id), query=query, query_blocks={"block": by[0]}, texts=list(texts),
        ref_blocks={"block": by[1]}, key=key, k=k, threshold=1e-6, tokens=S.words_of,
        score=F.col("shared") + F.col("sim"), **options,
    )


def geocode_fill(
    prospects: DataFrame,
    addresses: DataFrame,
    *,
    number: str = "adresse_numero",
    street: str = "adresse_voie_clean",
    on: tuple[str, str] = ("adresse", "code_postal"),
    housenumber: str = "housenumber",
    ref_street: str = "street",
) -> DataFrame:
    """Take number and street from an address reference where no number was parsed."""
    from kinlink.functions.text import fold_upper, street_clean

    ref = addresses.groupBy(*on).agg(F.min_by(F.struct(housenumber, ref_street), F.struct(housenumber, ref_street)).alias("__geo"))
    joined = prospects.join(ref, list(on), "left")
    use = (or_blank(F.col(number)) == "") & (or_blank(F.col(on[0])) != "") & (or_blank(F.col(f"__geo.{housenumber}")) != "")
    return (
        joined.withColumn(street, F.when(use, street_clean(fold_upper(or_blank(F.col(f"__geo.{ref_street}"))))).otherwise(F.col(street)))
        .withColumn(number, F.when(use, F.col(f"__geo.{housenumber}")).otherwise(F.col(number)))
        .drop("__geo")
    )


def best_variant_merge(candidates: DataFrame, *, query_id: str = "prospect_id", key: str = "siret", k: int = 10) -> DataFrame:
    """Merge the variants' results: the first variant to surface an id keeps it, then the k most similar ids."""
    kept = candidates.groupBy(query_id, key).agg(
        F.min_by(F.struct("sim", "variant_pos", "rank"), F.col("variant_pos")).alias("kept")
    )
    kept = kept.select(query_id, key, "kept.sim", "kept.variant_pos", F.col("kept.rank").alias("variant_rank"))
    return top_k_per_entity(kept, [query_id], [F.desc("sim"), F.col("variant_pos"), F.col("variant_rank")], k)
