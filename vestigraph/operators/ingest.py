"""From records to graph rows: names to ids, mapped edges, rows of business documents, and records of an extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigraph.functions import text as tx

# Relation names of the bridge format and their tokens, fields that are never stored.
RELATION_TOKENS = {"股权持有": "AFFILIATED_WITH", "控股": "AFFILIATED_WITH", "具有财务指标": "HAS_FINANCIAL_INDICATOR", "经营业务板块": "OPERATES_SEGMENT", "关联": "RELATED"}
DEFAULT_TOKEN, FORBIDDEN = "RELATED", ("pii_flags",)
# The class of relation records, its fields, and the relations that other classes imply (the field that names the tail, or none for the text).
HOLDS, OWNER, TARGET, KIND, COMPANY, LINKED = "控股关系", "主体", "标的", "关系类型", "公司", "关联"
IMPLIED = {"财务指标": ("具有财务指标", "指标名称"), "业务板块": ("经营业务板块", None)}


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def allowed(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, v: ~k.isin(*FORBIDDEN))


def entity_rows(entities: DataFrame, order: list[str]) -> DataFrame:
    """entities (id, name, type, attributes, ...): those with id and name, the first of each id by order; forbidden attributes go, a missing type is OTHER."""
    rows = entities.withColumns({"id": _said(F.col("id")), "name": _said(F.col("name"))}).where("id is not null and name is not null")
    first = rows.groupBy("id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "id")), F.struct(*order)).alias("r")).select("id", "r.*")
    return first.withColumns({"type": F.coalesce(_said(F.col("type")), F.lit("OTHER")), "attributes": allowed(F.coalesce("attributes", F.create_map().cast("map<string,string>")))})


def relation_rows(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, unresolved). relations name their ends (head, relation, tail, id, attributes); both names are looked up among entities (id, name).

    Names that several entities bear mean the one with the smallest id. Ends that no entity bears make the relation
    unresolved, with the ids found. Rows carry the relation's token and are distinct by id, ends and name.
    """
    names = entities.groupBy("name").agg(F.min("id").alias("id"))
    said = relations.withColumns({"head": _said(F.col("head")), "tail": _said(F.col("tail")), "relation": F.coalesce(_said(F.col("relation")), F.lit(LINKED))}).where("head is not null and tail is not null")
    found = said.withColumnRenamed("id", "rel_id")
    for end in ("head", "tail"):
        found = found.join(names.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")), end, "left")
    lost = found.where("head_id is null or tail_id is null").select("rel_id", "head", "head_id", "relation", "tail", "tail_id")
    token = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RELATION_TOKENS.items() for x in kv)), F.col("relation")), F.lit(DEFAULT_TOKEN))
    good = found.where("head_id is not null and tail_id is not null").withColumns({"token": token, "attributes": allowed(F.col("attributes"))})
    return good.dropDuplicates(["rel_id", "head_id", "tail_id", "relation"]).select("rel_id", "token", "relation", "head_id", "tail_id", "head", "tail", "attributes"), lost


def node_name(kind: Column, key: Column, name: Column, templates: dict[str, Column], node_id: Column) -> Column:
    """What a node is called: its own key where it was derived, else its name, else its type's template, else its id."""
    by_type = F.when(F.lit(False), node_id)
    for t, template in templates.items():
        by_type = by_type.when(kind == t, template)
    return F.coalesce(_said(key), _said(name), by_type, node_id)


def matched_edges(heads: DataFrame, tails: DataFrame, by: list[str], kind: str, head: str, tail: str, nodes: DataFrame, window: tuple[str, str, str] | None = None, fact_side: str = "head", fact: str | None = None) -> DataFrame:
    """Edges between rows of two tables that agree on all of `by`: id, relation_type, head, tail, valid_from, each pair once.

    Both ends must be nodes (id). window (start, end, at): the tail's day must lie between the head's two days, ends
    included. The fact's day comes from the side that the mapping names; of several the first counts.
    """
    own = lambda df, key, side, more: df.select(*(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in by), F.col(key).alias(side), *more)
    day = lambda side: [tx.fact_date(F.col(fact).cast("string")).alias(f"{side}_fact")] if fact and fact_side == side else []
    h = own(heads, head, "head", [*day("head"), *([F.col(window[0]).cast("string").alias("__a"), F.col(window[1]).cast("string").alias("__b")] if window else [])]).where("head is not null")
    t = own(tails, tail, "tail", [*day("tail"), *([F.substring(F.col(window[2]).cast("string"), 1, 10).alias("__at")] if window else [])]).where("tail is not null")
    met = h.join(t, by)
    if window:
        met = met.where("__at != '' and __at between __a and __b")
    for end in ("head", "tail"):
        met = met.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    at = F.min(f"{fact_side}_fact") if fact else F.lit(None).cast("string")
    return met.groupBy("head", "tail").agg(at.alias("valid_from")).select(F.concat(F.lit(kind + ":"), "head", F.lit("->"), "tail").alias("id"), F.lit(kind).alias("relation_type"), "head", "tail", "valid_from")


_NODE = ("id", "label", "name", "tax_id", "amount", "day", "trade_ref", "source_entity_ids")


def _nodes(rows: DataFrame, label: str, **columns: Column) -> DataFrame:
    kinds = {"amount": "double", "source_entity_ids": "array<string>"}
    of = lambda c: F.lit(label) if c == "label" else columns.get(c, F.lit(None))
    return rows.select(*(of(c).cast(kinds.get(c, "string")).alias(c) for c in _NODE))


def business_graph(suppliers: DataFrame, invoices: DataFrame, vouchers: DataFrame, contracts: DataFrame, shareholders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of four record sources and their shareholders.

    suppliers: tax_id, name, address, phone, rep_name, rep_id. invoices and vouchers: key, amount, day, trade_ref and
    aligned_id, the subject they were aligned with or null. contracts: the same with party_a and party_b (tax ids) and
    their names. shareholders: holder, held (tax ids). Suppliers with one address, phone or representative share its node.
    A subject's evidence is its aligned invoices and vouchers, a shared node's the subjects that have it. A contract's
    party that is no supplier becomes a subject; a shareholding between subjects that don't exist raises when read.
    """
    subject = lambda c: F.concat(F.lit("SUBJECT:"), tx.tax_id(F.col(c)))
    sup = suppliers.withColumns({"s": subject("tax_id"), "a": tx.address_id(F.col("address")), "p": tx.person_id(F.col("rep_name"), F.col("rep_id")), "t": tx.phone_id(F.col("phone"))})
    edge = lambda df, kind, head, tail, tag="": df.select(F.concat(F.lit(kind + ":"), head, F.lit("->"), tail, F.lit(tag)).alias("id"), F.lit(kind).alias("kind"), head.alias("head"), tail.alias("tail"))
    c = F.col
    own = [(invoices, "INVOICE", "Invoice"), (vouchers, "VOUCHER", "Voucher"), (contracts, "CONTRACT", "Contract")]
    records = {label: df.withColumn("n", F.concat(F.lit(kind + ":"), F.trim("key"))) for df, kind, label in own}
    edges = [edge(sup, "REGISTERED_AT", c("s"), c("a")), edge(sup, "LEGAL_REP", c("s"), c("p")), edge(sup, "CONTACT_PHONE", c("s"), c("t"))]
    issued = records["Invoice"].where("aligned_id is not null")
    posted = records["Voucher"].where("aligned_id is not null")
    edges += [edge(issued, "ISSUED", c("aligned_id"), c("n")), edge(posted, "POSTED_IN", c("n"), c("aligned_id"))]
    parties = []
    for role in ("a", "b"):
        party = records["Contract"].withColumn("s", subject(f"party_{role}"))
        party = party.withColumn("s", F.coalesce("s", F.raise_error(F.concat(F.lit("contract with a bad tax id: "), F.trim("key"))).cast("string")))
        edges.append(edge(party, "PARTY_TO", c("s"), c("n"), f":{role.upper()}"))
        parties.append(party.select("s", F.lit(role).alias("role"), c(f"party_{role}_name").alias("name"), "key"))
    told = issued.select(c("aligned_id").alias("s"), "n").unionByName(posted.select(c("aligned_id").alias("s"), "n")).groupBy("s").agg(F.sort_array(F.collect_set("n")).alias("ids"))
    named = sup.select("s", F.trim("name").alias("name"), F.lit("").alias("role"), F.lit("").alias("key")).unionByName(reduce(DataFrame.unionByName, parties))
    # A supplier names itself; other parties are called as in the first contract.
    subjects = named.groupBy("s").agg(F.min_by(F.trim("name"), F.struct("role", "key")).alias("name")).join(told, "s", "left")
    none = F.array().cast("array<string>")
    nodes = [_nodes(subjects, "Subject", id=c("s"), name=c("name"), tax_id=F.substring("s", 9, 18), source_entity_ids=F.coalesce("ids", none))]
    for label, key, name in (("Address", "a", F.trim("address")), ("LegalPerson", "p", F.trim("rep_name")), ("Phone", "t", F.lit("phone"))):
        shared = sup.groupBy(key).agg(F.min(name).alias("name"), F.sort_array(F.collect_set("s")).alias("ids"))
        nodes.append(_nodes(shared, label, id=c(key), name=c("name"), source_entity_ids=c("ids")))
    for label, df in records.items():
        nodes.append(_nodes(df, label, id=c("n"), name=F.trim("key"), amount=c("amount"), day=F.trim(c("day").cast("string")), trade_ref=_said(c("trade_ref")), source_entity_ids=F.array("n")))
    held = shareholders.withColumns({"h": subject("holder"), "t": subject("held")})
    for end in ("h", "t"):
        there = subjects.select(c("s").alias(end), F.lit(True).alias(f"__{end}"))
        held = held.join(there, end, "left").withColumn(end, F.when(c(f"__{end}"), c(end)).otherwise(F.raise_error(F.concat(F.lit("no such subject: "), F.coalesce(end, F.lit("null")))).cast("string")))
    edges.append(edge(held, "SHARES_HOLDER", c("h"), c("t")))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def from_extraction(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of extraction records: doc, nth, kind, text, attributes (map), grounded.

    Records of a shareholding give a relation between companies; all others an entity, and for some kinds a relation to
    their company too. Ends without a record of their own become entities (auto_created). An entity is a name within a
    document, as first met; relations are distinct by ends, name and attributes, as first met.
    """
    text, a = _said(F.col("text")), lambda k: _said(F.try_element_at("attributes", F.lit(k)))
    rows = records.withColumn("text", text).where("text is not null").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    without = lambda *ks: F.map_filter("attributes", lambda k, v: ~k.isin(*ks))
    base = lambda df, head, name, tail, tail_type, derived, attrs: df.select("doc", "nth", head.alias("head"), F.lit(COMPANY).alias("head_type"), name.alias("relation"), tail.alias("tail"), tail_type.alias("tail_type"), F.lit(derived).alias("derived"), attrs.alias("attributes"), "text").where("head is not null and tail is not null")
    relations = [base(rows.where(F.col("kind") == HOLDS), a(OWNER), F.coalesce(a(KIND), F.lit(LINKED)), F.coalesce(a(TARGET), F.col("text")), F.lit(COMPANY), False, without(OWNER, TARGET, KIND))]
    for kind, (name, field) in IMPLIED.items():
        implied = base(rows.where(F.col("kind") == kind), a(OWNER), F.lit(name), a(field) if field else F.col("text"), F.lit(kind), True, without(OWNER))
        relations.append(implied.where("head != tail"))
    met = reduce(DataFrame.unionByName, relations).withColumn("sorted", F.to_json(F.array_sort(F.map_entries("attributes"))))
    # step: within one record the entity itself comes before the ends that it implies, the head before the tail.
    own = rows.where(F.coalesce(F.col("kind"), F.lit("")) != HOLDS).select("doc", F.col("text").alias("name"), "nth", F.lit(0).alias("step"), F.coalesce(_said(F.col("kind")), F.lit("OTHER")).alias("type"), F.coalesce("grounded", F.lit(False)).alias("grounded"), F.lit(False).alias("auto_created"))
    ends = [met.select("doc", F.col(e).alias("name"), "nth", F.lit(i).alias("step"), F.col(f"{e}_type").alias("type"), F.lit(False).alias("grounded"), F.lit(True).alias("auto_created")) for i, e in enumerate(("head", "tail"), 1)]
    every = own.unionByName(ends[0]).unionByName(ends[1])
    entities = every.groupBy("doc", "name").agg(F.min(F.struct("nth", "step", "type", "grounded", "auto_created")).alias("f")).select("doc", "name", "f.type", "f.grounded", "f.auto_created")
    first = met.groupBy("doc", "head", "relation", "tail", "sorted").agg(F.min(F.struct("nth", "head_type", "tail_type", "derived", F.col("text").alias("evidence"))).alias("f"))
    return entities, first.select("doc", "head", "relation", "tail", F.col("sorted").alias("attributes"), "f.head_type", "f.tail_type", "f.derived", "f.evidence")


def affiliation_rows(entities: DataFrame, relations: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of subjects, legal persons and addresses from extracted entities (id, entity_type, canonical_name, char_start) and relations (source_entity_id, target_entity_id, relation_type, valid_from, valid_to, source_document_id).

    Only ORG -LEGAL_REP-> LEGAL_PERSON and ORG -REGISTERED_AT-> ADDRESS count; nodes are named by a digest of the trimmed
    name, so those of different documents meet, and keep the ids of the entities they come from. Edges carry the place of
    their target for arbitration and are merged over documents to the earliest start.
    """
    from vestigraph.operators import temporal

    e = entities.select("id", "entity_type", F.trim("canonical_name").alias("name"), "char_start")
    side = lambda s: e.select(*(F.col(c).alias(f"{s}_{c}") for c in e.columns))
    rows = relations.join(side("s"), F.col("source_entity_id") == F.col("s_id")).join(side("t"), F.col("target_entity_id") == F.col("t_id"))
    wanted = F.when((F.col("relation_type") == "LEGAL_REP") & (F.col("t_entity_type") == "LEGAL_PERSON"), "lpr").when((F.col("relation_type") == "REGISTERED_AT") & (F.col("t_entity_type") == "ADDRESS"), "adr")
    rows = rows.where("s_entity_type = 'ORG'").withColumn("kind", wanted).where("kind is not null and t_name != ''")
    node = lambda prefix, c: F.concat(prefix, F.lit("-"), F.substring(F.sha2(c, 256), 1, 16))
    rows = rows.withColumns({"head": node(F.lit("sub"), F.coalesce("s_name", F.lit(""))), "tail": node(F.col("kind"), F.col("t_name"))})
    heads = rows.select(F.col("head").alias("id"), F.lit("Subject").alias("label"), F.col("s_name").alias("name"), F.col("s_id").alias("source"))
    tails = rows.select(F.col("tail").alias("id"), F.when(F.col("kind") == "lpr", "LegalPerson").otherwise("Address").alias("label"), F.col("t_name").alias("name"), F.col("t_id").alias("source"))
    nodes = heads.unionByName(tails).groupBy("id", "label").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("source")).alias("source_entity_ids"))
    facts = rows.select("relation_type", "head", "tail", "valid_from", "valid_to", F.struct("source_document_id", "t_char_start").alias("source"), F.col("source_document_id").alias("told"), F.col("t_char_start").alias("place"), F.col("valid_from").alias("o_from"), F.col("valid_to").alias("o_to"))
    merged = temporal.earliest_fact(facts, ["relation_type", "head", "tail"], ["told", "place", "o_from", "o_to"])
    short = F.when(F.col("relation_type") == "LEGAL_REP", "lr").otherwise("ra")
    return nodes, merged.select(F.concat_ws(":", F.lit(version), short, "head", "tail").alias("id"), "relation_type", "head", "tail", "valid_from", "valid_to", F.col("source.source_document_id").alias("source_document_id"), F.col("source.t_char_start").alias("tail_position"))


def merged_back(aligned: DataFrame, merges: DataFrame, key: str, level: str = "resolution") -> DataFrame:
    """aligned (key, level, aligned_id, reason) after automatic merges (key, canonical_id): what was not aligned and was merged is aligned now."""
    rows = aligned.join(merges.select(key, "canonical_id"), key, "left")
    now = F.col("aligned_id").isNull() & F.col("canonical_id").isNotNull()
    return rows.select(key, F.when(now, level).otherwise(F.col("level")).alias("level"), F.coalesce("aligned_id", "canonical_id").alias("aligned_id"), F.when(~now, F.col("reason")).alias("reason"))


def _recipe(prefix: str, *parts: Column) -> Column:
    each = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *each), 256), 1, 12))


def stable_ids(entities: DataFrame, relations: DataFrame, document: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Ids that a repeated extraction gives again, so that a repeated load adds nothing.

    entities: document, id, canonical_name, entity_type, char_start, char_end: the new id comes from all but the old one, so
    repeated mentions of one place become one. relations: document, source_entity_id, relation_type, target_entity_id: their
    ends follow, and their own id comes from ends and type; ends without an entity keep their id. Of rows that share an id
    the one with the smallest old id stays.
    """
    new = _recipe("ent_", F.col(document), *(F.col(c) for c in ("canonical_name", "entity_type", "char_start", "char_end")))
    named = entities.withColumn("new_id", new)
    ids = named.select(document, F.col("id").alias("old"), "new_id").distinct()
    out = relations
    for end in ("source_entity_id", "target_entity_id"):
        side = ids.select(document, F.col("old").alias(end), F.col("new_id").alias("to"))
        out = out.join(side, [document, end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
    out = out.withColumn("id", _recipe("rel_", F.col("source_entity_id"), F.col("relation_type"), F.col("target_entity_id")))
    once = named.groupBy("new_id").agg(F.min_by(F.struct(*entities.columns), F.col("id")).alias("e")).select(*(F.col("new_id").alias("id") if c == "id" else F.col(f"e.{c}") for c in entities.columns))
    return once, out.select(document, "id", "source_entity_id", "relation_type", "target_entity_id").dropDuplicates([document, "id"])
