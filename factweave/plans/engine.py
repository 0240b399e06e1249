"""One method per operation, over a store."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_alias, string_only, value_to_string
from ..operators import aggregates, aliases, conflicts, discovery, dml, extraction, facts as fa, graph, grounding, pages, reconcile, search, vectors, views
from ..schemas import KEYS
from ..sources import files as sources
from ..sources.store import Store


def releasing(method):
    """What a method keeps in memory is let go when it ends: a kept plan over the
    same paths would otherwise answer for files that have changed since."""

    @wraps(method)
    def run(self, *args, **kwargs):
        try:
            return method(self, *args, **kwargs)
        finally:
            while self._kept:
                self._kept.pop().unpersist()

    return run


class Engine:
    def __init__(self, spark: SparkSession, root: str, registry: sources.Registry | None = None):
        self._kept: list[DataFrame] = []
        self._graph: tuple[int, DataFrame] | None = None
        #: Counts of the last ingestion (files by status), classification, embedding, resolution or extraction.
        self.stats: dict[str, int] = {}
        self.usage: dict[str, int] = {}
        self.spark, self.store, self.registry = spark, Store(spark, root), registry or sources.default_registry()

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    # -- ingestion -----------------------------------------------------------

    def ingest(self, folder: str, observed_at: int = 0, dry_run: bool = False, options: sources.WalkOptions = sources.WalkOptions()) -> DataFrame:
        """Ingest a folder; the discovered schemas (path, schema, id_column)."""
        return self.ingest_items(sources.walk(self.spark, folder, self.registry, options), observed_at, dry_run)

    def ingest_files(self, files: DataFrame, observed_at: int = 0, dry_run: bool = False) -> DataFrame:
        """As ``ingest``, of ``binaryFile`` rows, each read whole."""
        return self.ingest_items(sources.parse(files, self.registry), observed_at, dry_run)

    @releasing
    def ingest_items(self, items: DataFrame, observed_at: int = 0, dry_run: bool = False) -> DataFrame:
        """Files known by path and hash are passed over. The tables are only appended
        to: of what a changed file said before, the ids are written as removed."""
        found = discovery.discover_schemas(sources.records(items))
        if dry_run:
            return found
        recs = self._keep(sources.records(items))
        incoming = recs.select("path", "content_hash", "adapter").distinct()
        version, old = self.store.read()
        status = self._keep(dml.delta_status(incoming, old["documents"]))
        stale, new = status.where("status = 'stale'"), status.where("status <> 'cached'")
        self.stats = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        if not self.stats.keys() - {"cached"}:
            return found
        docs = dml.number_on(incoming.join(new.select("path"), "path", "left_semi"), ["path"], dml.top_id(old["documents"]))
        docs = self._keep(docs.withColumn("ingested_at", F.lit(observed_at).cast("long")))
        mine = recs.join(docs.select("path", F.col("id").alias("document_id")), "path")
        cells = self._keep(self._facts(mine, discovery.discover_schemas(recs), observed_at))
        seen = cells.select(F.col("subject").alias("id"), "entity_type", F.struct("path", "pos").alias("seq"))
        facts = dml.numbered(old["facts"], cells.where("predicate IS NOT NULL").drop("entity_type"), ["path", "pos", "predicate"])
        append = {"documents": docs, "entities": dml.new_rows(old["entities"], seen, ["id"], "seq"), "facts": facts}
        self.store.commit(version, append, dml.removals(old, stale) if self.stats.get("stale") else None)
        return found

    @staticmethod
    def _facts(recs: DataFrame, schemas: DataFrame, observed_at: int) -> DataFrame:
        """Facts of records with an id; columns whose first values are mostly ids
        of another schema become references. A record without other keys still
        gives its entity (predicate null)."""
        r = recs.join(schemas.where("id_column IS NOT NULL").select("path", "id_column"), "path")
        r = r.withColumn("subject", value_to_string(F.element_at("fields", F.col("id_column")))).where("subject <> ''")
        cells = r.select("path", "adapter", "document_id", "pos", "schema", "subject", "id_column", F.explode_outer("fields").alias("key", "obj"))
        attrs = cells.where("key <> id_column")
        vals = attrs.select("path", "schema", "key", "pos", value_to_string(F.col("obj")).alias("v"))
        fks = discovery.fk_columns(vals, r.select("schema", F.col("subject").alias("id"))).select("path", "key", "target")
        base = attrs.join(fks, ["path", "key"], "left").select(
            "path", "pos", "subject", F.col("schema").alias("entity_type"), F.coalesce(F.concat(F.lit("ref:"), "target"), F.col("key")).alias("predicate"),
            F.col("obj").alias("object_json"), "document_id", "adapter",
        )
        bare = r.select("path", "pos", "subject", F.col("schema").alias("entity_type"), F.lit(None).cast("string").alias("predicate"), F.lit(None).cast("string").alias("object_json"), "document_id", "adapter")
        return base.unionByName(bare).withColumns({"confidence": F.lit(1.0), "observed_at": F.lit(observed_at).cast("long"), "locator": F.lit(None).cast("string")})

    def sections(self, folder: str, options: sources.WalkOptions = sources.WalkOptions(), min_chars: int = 200, min_ratio: float = 0.5) -> DataFrame:
        """What ``extract`` is to read in a folder: (section, parent_subject,
        parent_type, field, text, locator) of the long values of records' text
        fields, and of text sections under a ``document`` parent."""
        items = sources.walk(self.spark, folder, self.registry, options)
        recs = sources.records(items)
        known = recs.join(discovery.discover_schemas(recs).where("id_column IS NOT NULL").select("path", "id_column"), "path")
        cells = known.select(
            "path", "pos", F.col("schema").alias("parent_type"), "id_column", value_to_string(F.element_at("fields", F.col("id_column"))).alias("parent_subject"), F.explode("fields").alias("field", "obj")
        ).withColumn("text", string_only(F.col("obj"))).where("trim(text) <> '' AND field <> id_column")
        long = (F.length(F.trim("text")) >= min_chars).cast("double")
        fields = cells.groupBy("path", "field").agg(F.avg(long).alias("ratio")).where(F.col("ratio") >= min_ratio).select("path", "field")
        jobs = cells.where(F.length(F.trim("text")) >= min_chars).join(fields, ["path", "field"]).select(
            F.concat("path", F.lit("#"), "pos", F.lit("/"), "field").alias("section"), "parent_subject", "parent_type", "field", "text",
            F.concat("id_column", F.lit("="), "parent_subject", F.lit("/"), "field").alias("locator"),
        )
        whole = fa.section_jobs(sources.sections(items)).withColumn("section", F.concat("parent_subject", F.lit("#"), "field"))
        return jobs.unionByName(whole.select(*jobs.columns))

    # -- derivation ----------------------------------------------------------

    def alias_index(self) -> int:
        version, t = self.store.read()
        new = aliases.derive_aliases(t["facts"], t["entities"], t["resolution_blocklist"]).withColumn("seq", F.lit(1))
        self.store.commit(version, entity_aliases=aliases.upsert_aliases(t["entity_aliases"], new))
        return self.store.table("entity_aliases").count()

    def clear_aliases(self) -> None:
        self.store.commit(entity_aliases=self.store.table("entity_aliases").limit(0))

    @releasing
    def reconcile_refs(self, discount: float = 0.9, observed_at: int = 0) -> int:
        version, t = self.store.read()
        new = self._keep(reconcile.reconcile(t["facts"], t["entities"], t["entity_aliases"], discount, observed_at))
        n = new.count()
        if n:
            self.store.commit(version, {"facts": dml.numbered(t["facts"], new, ["subject", "predicate", "object_json"])})
        return n

    def clear_reconciled(self) -> None:
        """Without the references that aliases implied, and their conflicts."""
        version, t = self.store.read()
        new = dml.clear_reconciled(t)
        self.store.commit(version, facts=new["facts"], conflicts=new["conflicts"])

    @releasing
    def embed(self, client, model: str, at: int = 0, force: bool = False, limit: int | None = None) -> int:
        version, t = self.store.read()
        cards = vectors.stale_cards(vectors.card_text(t["facts"], t["entities"], t["entity_aliases"]), t["entity_embeddings"], model, force, limit)
        new = self._keep(vectors.embed_cards(cards, client, model, at))
        n = new.count()
        self.stats = {"embedded": n}
        self.store.commit(version, entity_embeddings=dml.keep_latest(t["entity_embeddings"], new, KEYS["entity_embeddings"], "created_at"))
        return n

    @releasing
    def cleanup_conflicts(self, client, at: int = 0) -> int:
        """Classify predicates anew and detect conflicts."""
        version, old = self.store.read()
        t = dml.clear_cardinality(old)
        evidence = conflicts.multivalue_evidence(t["facts"], t["entities"], t["predicate_cardinality"])
        decided = self._keep(extraction.classify(evidence, client).withColumns({"decided_by": F.lit("model"), "decided_at": F.lit(at).cast("long")}))
        self.stats = {r["cardinality"]: r["n"] for r in decided.groupBy("cardinality").agg(F.count("*").alias("n")).collect()}
        found = conflicts.detect_conflicts(t["facts"], t["entities"], decided, t["conflicts"])
        new = found.withColumns({"resolved_at": F.lit(None).cast("long"), "resolution": F.lit(None).cast("string")})
        self.store.commit(version, predicate_cardinality=decided, conflicts=dml.append_facts(t["conflicts"], new, ["subject", "predicate", "fact_a_id", "fact_b_id"]))
        return self.store.table("conflicts").where("resolved_at IS NULL").count()

    @releasing
    def resolve(self, at: int = 0, config: conflicts.ResolverConfig = conflicts.ResolverConfig()) -> DataFrame:
        """Decide what the policy can; (decision, n) of the open conflicts."""
        version, t = self.store.read()
        done = self._keep(conflicts.resolve(t["conflicts"].where("resolved_at IS NULL"), t["facts"], config))
        stats = self.spark.createDataFrame(done.groupBy("decision").count().collect(), "decision string, n long")
        self.stats = {r["decision"]: r["n"] for r in stats.collect()}
        put = done.select("id", "preferred")
        new = t["conflicts"].join(put, "id", "left").withColumns({
            "resolved_at": F.when(F.col("preferred").isNotNull(), F.lit(at)).otherwise(F.col("resolved_at")), "resolution": F.coalesce("preferred", "resolution"),
        })
        self.store.commit(version, conflicts=new.drop("preferred"))
        return stats

    def resolve_one(self, conflict_id: int, side: str, at: int = 0) -> None:
        version = self.store.version()
        c = self.store.table("conflicts", version)
        row = c.where(F.col("id") == conflict_id).first()
        if row is None or side not in ("a", "b"):
            raise ValueError(f"no such choice: {conflict_id} {side}")
        self.store.commit(version, conflicts=dml.resolve_conflict(c, conflict_id, f"prefer:{row[f'fact_{side}_id']}", at))

    def approve(self, entity_id: str, surface: str) -> None:
        """A reviewer accepts a link: its surface becomes an alias."""
        version, t = self.store.read()
        new = self.spark.createDataFrame([(entity_id, surface.strip())], "entity_id string, alias string").select(
            "entity_id", "alias", normalize_alias(F.col("alias")).alias("alias_norm"), F.lit("derived").alias("source"), F.lit(1.0).alias("confidence"), F.lit(1).alias("seq")
        ).where(F.octet_length("alias_norm") >= 2)
        self.store.commit(version, entity_aliases=aliases.upsert_aliases(t["entity_aliases"], new))

    def reject(self, subject: str, predicate: str, entity_id: str, surface: str, at: int = 0) -> None:
        """A reviewer refuses a link: it is suppressed and never derived again.
        An alias that is there stays."""
        version, t = self.store.read()
        block = self.spark.createDataFrame([(surface, entity_id, at)], "s string, entity_id string, blocked_at long").select(normalize_alias(F.col("s")).alias("alias_norm"), "entity_id", "blocked_at")
        self.store.commit(
            version, resolution_blocklist=dml.keep_latest(t["resolution_blocklist"], block, KEYS["resolution_blocklist"], "blocked_at"),
            facts=dml.suppress_fact(t["facts"], subject, predicate, entity_id),
        )

    def extract(self, sections: DataFrame, client, at: int = 0, most: int | None = None, lots: int = 1, concurrency: int = 1) -> int:
        """Ask a model about sections (section, parent_subject, text) that aren't
        cached, ground what it says, and keep it.

        Sections whose call failed stay uncached and are asked about again. With
        ``lots`` the sections are dealt by their text's hash into so many commits,
        and an interruption loses one of them. ``usage`` then holds the calls and
        tokens of the run."""
        self.usage = {}
        return sum(self._extract(sections.where(F.pmod(F.xxhash64("text"), F.lit(lots)) == lot) if lots > 1 else sections, client, at, most, concurrency) for lot in range(lots))

    @releasing
    def _extract(self, sections: DataFrame, client, at: int, most: int | None, concurrency: int) -> int:
        version, t = self.store.read()
        todo = self._keep(grounding.uncached(sections, t["section_cache"], most))
        cands = reconcile.text_candidates(todo, t["entities"], t["entity_aliases"]).groupBy("section").agg(F.sort_array(F.collect_list(F.struct("place", "entity_id", "entity_type", "surface"))).alias("candidates"))
        got = self._keep(extraction.extract_sections(todo.join(cands, "section", "left"), client, concurrency))
        refs = got.where("kind = 'ref'").select("section", "entity_id", "evidence_span", "confidence")
        grounded = self._keep(grounding.ground_refs(refs, todo.select("section", "parent_subject", "text"), t["entities"], t["entity_aliases"], at))
        said = got.where("kind = 'fact'").select("section", "subject", "predicate", "object_json", F.lit("llm").alias("adapter"), "confidence", F.lit(at).cast("long").alias("observed_at"), F.lit(None).cast("string").alias("locator"))
        new = said.unionByName(grounded.select(*said.columns))
        counts = new.groupBy("section").agg(F.count("*").alias("fact_count"))
        done = got.where("kind = 'done'").select("section")
        cached = todo.join(done, "section", "left_semi").join(counts, "section", "left").select("section_hash", F.lit(at).cast("long").alias("extracted_at"), F.coalesce("fact_count", F.lit(0)).alias("fact_count"))
        learned = grounding.learned_aliases(grounded).withColumn("seq", F.lit(1))
        for r in extraction.usage_of(got).collect():  # a row for each counter
            self.usage[r["name"]] = self.usage.get(r["name"], 0) + r["n"]
        n = new.count()
        self.store.commit(
            version, {
                "facts": dml.numbered(t["facts"], new.drop("section"), ["subject", "predicate", "object_json"]),
                "section_cache": dml.new_rows(t["section_cache"], cached, KEYS["section_cache"]),
            }, entity_aliases=aliases.upsert_aliases(t["entity_aliases"], learned),
        )
        return n

    @releasing
    def embed_sections(self, sections: DataFrame, client, model: str, at: int = 0) -> DataFrame:
        """(section, embedding) of ``sections(section, text)``, from the cache by the
        text's hash and the model, else embedded now and kept."""
        version, t = self.store.read()
        new = self._keep(vectors.embed_new_sections(sections, t["section_embeddings"], client, model, at))
        if not new.isEmpty():
            self.store.commit(version, {"section_embeddings": new})
        return vectors.section_vectors(sections, self.store.table("section_embeddings"), model)

    def nearest_entities(self, sections: DataFrame, client, model: str, k: int = 20, at: int = 0) -> DataFrame:
        """(section, entity_id, score, rank) by cosine of the sections' embeddings
        to the stored ones of that model."""
        q = self.embed_sections(sections, client, model, at).select(F.col("section").alias("id"), F.col("embedding").alias("vec"))
        v = vectors.entity_vectors(self.store.table("entity_embeddings"), self.store.table("entities"), model)
        top = vectors.cosine_topk(q, v.select("id", "vec"), k)
        return top.select(F.col("query_id").alias("section"), F.col("id").alias("entity_id"), "score", "rank")

    # -- questions -----------------------------------------------------------

    def entity_counts(self) -> DataFrame:
        return aggregates.entity_counts(self.store.table("entities"))

    def predicate_counts(self, entity_type: str | None = None) -> DataFrame:
        return aggregates.predicate_counts(self.store.table("facts"), self.store.table("entities"), entity_type)

    def top_values(self, predicate: str, limit: int = 20) -> DataFrame:
        return aggregates.top_values(self.store.table("facts"), predicate, limit)

    def index(self, path: str) -> None:
        search.write_index(search.payloads(self.store.table("facts"), self.store.table("entities")), path)

    def search(self, query: str, k: int = 10, hops: int = 0, path: str | None = None) -> DataFrame:
        """Hits from the index written at ``path``; without one the store is indexed
        for this query."""
        f, e = self.store.table("facts"), self.store.table("entities")
        if path is None:
            hits = search.bm25(*search.index(search.payloads(f, e)), query, k)
        else:
            hits = self.spark.createDataFrame(search.search_index(self.spark, path, query, k)[0], "id string, score double")
        if hops <= 0:
            return hits.select("id", F.lit(0).alias("distance"), "score")
        return graph.expand(self.graph(), e, hits, hops).join(hits, "id", "left").select("id", "distance", "score")

    def graph(self) -> DataFrame:
        """The reference graph, kept until the store's version changes."""
        version = self.store.version()
        if self._graph is None or self._graph[0] != version:
            if self._graph is not None:
                self._graph[1].unpersist()
            self._graph = version, graph.graph_edges(self.store.table("facts", version), self.store.table("entities", version)).persist()
        return self._graph[1]

    def list_entities(self, entity_type: str, contains: str | None = None, limit: int | None = None) -> dict:
        """{total, ids} of a type's ids that hold ``contains`` in any case, in order."""
        e = dml.entities_holding(self.store.table("entities"), entity_type, contains)
        ids = e.orderBy("id") if limit is None else e.orderBy("id").limit(limit)
        return {"total": e.count(), "ids": [r["id"] for r in ids.collect()]}

    def show(self, entity_id: str, backlinks: int = 100) -> dict:
        """One entity: label, facts with their targets' labels, the number of its
        backlinks and the first of them with labels, aliases."""
        f, e, a = self.store.table("facts"), self.store.table("entities"), self.store.table("entity_aliases")
        kind = e.where(F.col("id") == entity_id).first()
        back = graph.incoming_of(f, e, entity_id)
        own = fa.facts_for_subject(f, entity_id).withColumn("target", F.when(F.col("predicate").startswith("ref:"), string_only(F.col("object_json"))))
        rows, first = own.collect(), back.limit(backlinks).collect()
        wanted = {entity_id, *(r["target"] for r in rows if r["target"]), *(r["subject"] for r in first)}
        ids = self.spark.createDataFrame([(i,) for i in sorted(wanted)], "id string")
        known = ids.join(e.select("id"), "id", "left_semi")
        label = {r["id"]: r["label"] for r in aliases.entity_labels(known, a.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")).collect()}
        facts_out = [
            {k: r[k] for k in ("predicate", "object_json", "adapter", "confidence", "locator")}
            | ({"target_type": r["predicate"][4:], "target_label": label.get(r["target"])} if r["predicate"].startswith("ref:") else {}) for r in rows
        ]
        return {
            "id": entity_id, "type": kind["entity_type"] if kind else None, "label": label.get(entity_id, entity_id), "facts": facts_out,
            "attributes": [(r["predicate"], r["object_json"]) for r in rows if not r["predicate"].startswith("ref:")],
            "references": [(r["predicate"], r["object_json"]) for r in rows if r["predicate"].startswith("ref:")],
            "incoming_total": back.count(), "incoming": [(r["predicate"], r["subject"]) for r in first],
            "backlinks": [r.asDict() | {"subject_label": label.get(r["subject"])} for r in first],
            "sources": len({r["adapter"] for r in rows}), "aliases": [r["alias"] for r in aliases.aliases_for(a, entity_id).select("alias").collect()],
        }

    def shown(self, entity_id: str, form: str = "text") -> str:
        """``show`` as text, json or md."""
        got = self.show(entity_id)
        if form == "json":
            return views.as_json(got)
        if form == "md":
            t = self.store.tables()
            one = t["entities"].where(F.col("id") == entity_id)
            return views.rendered(views.render_context(t["facts"].where((F.col("subject") == entity_id) | F.col("predicate").startswith("ref:")), one, t["entity_aliases"], aliases.entity_labels(one, t["entity_aliases"]), t["entities"])).first()["markdown"]
        return views.as_text(got)

    def conflict(self, conflict_id: int) -> dict | None:
        """Both sides of a conflict, its entity's label and the side to prefer."""
        t = self.store.tables()
        c = conflicts.conflict_sides(t["conflicts"].where(F.col("id") == conflict_id), t["facts"]).withColumn("recommended", conflicts.recommended_side())
        got = c.first()
        if got is None:
            return None
        label = aliases.entity_labels(t["entities"].where(F.col("id") == got["subject"]), t["entity_aliases"].where(F.col("entity_id") == got["subject"])).first()
        return got.asDict() | {"subject_label": label["label"] if label else None}

    def build(self, folder: str, templates: dict[str, str] | None = None) -> dict[str, int]:
        """Markdown pages of all entities, in a folder that the executors share."""
        t = self.store.tables()
        labels = aliases.entity_labels(t["entities"], t["entity_aliases"])
        return views.write_tree(views.rendered(views.render_context(t["facts"], t["entities"], t["entity_aliases"], labels), templates), folder)

    def generate_pages(self, client, folder: str, entity_type: str | None = None, limit: int | None = None, retries: int = 3, force: bool = False) -> dict[str, int]:
        """Model-written pages of entities that have none in ``folder`` (which the
        executors share): types in the order the model ranks them, then by id."""
        t = self.store.tables()
        order = pages.rank_types([(r["entity_type"], r["n"]) for r in self.entity_counts().collect()], client)
        work = pages.work_order(t["entities"] if entity_type is None else t["entities"].where(F.col("entity_type") == entity_type), order)
        if not force:
            work = pages.without_page(work, folder)
        if limit is not None:
            work = work.orderBy("rank", "id").limit(limit)
        context = pages.full_context(t["facts"], t["entities"], t["entity_aliases"], work)
        return pages.write_pages(context, client, folder, retries, force)

    def page(self, client, entity_type: str, entity_id: str, folder: str | None = None, force: bool = False) -> str:
        """One model-written page, kept in ``folder`` where one is given."""
        if folder is not None and not force and (known := pages.read_page(folder, entity_type, entity_id)) is not None:
            return known
        t = self.store.tables()
        one = t["entities"].where((F.col("id") == entity_id) & (F.col("entity_type") == entity_type))
        row = pages.full_context(t["facts"], t["entities"], t["entity_aliases"], one).first()
        if row is None:
            raise KeyError(f"{entity_type}/{entity_id}")
        return pages.write_page(client, folder, entity_type, entity_id, row["context"], force)

    def clear_llm(self) -> None:
        version, t = self.store.read()
        new = dml.clear_llm(t)
        self.store.commit(version, **{k: new[k] for k in ("facts", "conflicts", "section_cache", "entity_aliases")})

    def inspect(self) -> DataFrame:
        return aggregates.summary(**self.store.tables())
