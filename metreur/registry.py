"""The registered queries: each operator over whole given tables.

A query takes a session and a table folder. Its name starts with the operator's
id in the inventory; :mod:`metreur.checks` holds the statement it is compared
with where one can say the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metreur.functions import codes, similarity, text, units
from metreur.operators import enrich, evaluate, headings, lines, listing, ordered, overlay, perimeter, rollup, stats
from metreur.plans import evaluation, reprocess
from metreur.plans.extract import extract_lines, retry_perimeter
from metreur.session import checkpoint_folder, cut_lineage, passing_steps, ship_package, store_step
from metreur.sources import bills, contract, layout, manifest
from metreur.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Views:
    """Views of one table folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name)


def query(build: Callable[[Views], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(Views(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def _flat(c: Column) -> Column:
    """An array as text, so that both engines show it alike."""
    return F.array_join(c.cast("array<string>"), "|")


# ------------------------------------------------------------------- sources


@query
def s1_manifest(v):
    files = v.documents.select(
        F.concat(F.lit("corpus/"), "source", F.lit("/a:"), F.col("doc_id").cast("string"),
                 F.when(F.col("lang") == "en", ".docx").when(F.col("lang") == "fr", ".PDF").otherwise(".doc")).alias("path"),
        F.length("text").cast("bigint").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )
    found = manifest.limit_documents(manifest.describe_files(files))
    return found.select("dossier_id", "original_name", "extension", "size", "sha256", "reject_reason")


def _spans(v) -> DataFrame:
    words = F.posexplode(F.split("text", " ")).alias("at", "word")
    return v.pdf_lines.select("*", words).select(
        "source_id", "page", "line_no", (F.col("at") + 1).alias("span_no"), F.concat("word", F.lit(" ")).alias("text"),
        (F.lit(8.0) + F.length("word") % 5).alias("size"),
        F.when(F.length("word") > 12, 16).otherwise(4).alias("flags"),
        F.when(F.col("word").startswith("Et"), "Arial-Bold").otherwise("Arial").alias("font"),
        (F.col("x0") + F.col("at")).alias("x0"), "y0", (F.col("x0") + F.col("at") + 5).alias("x1"), "y1", "page_width", "page_height",
    )


@query
def s3_assemble_pdf_lines(v):
    return layout.assemble_pdf_lines(_spans(v)).drop("page_width", "page_height")


@query
def s4_merge_split_headings(v):
    return layout.merge_split_headings(v.pdf_lines.drop("n")).drop("page_width", "page_height", "y0")


@query
def s5_drop_repeated_boundaries(v):
    lines_ = v.pdf_lines
    pages = lines_.groupBy("source_id").agg(F.max("page").alias("page_count"))
    return layout.drop_repeated_boundaries(lines_, pages).select("source_id", "page", "line_no", "text")


@query
def s6_flag_pdf_headings(v):
    lines_ = v.pdf_lines.withColumn("merged_heading", F.col("n") % 11 == 0)
    sizes = layout.body_sizes(lines_.select("source_id", "text", "size"))
    return layout.flag_pdf_headings(lines_, sizes).select("source_id", "pos", "style", "font_size", "source_kind", "x0", "y1")


@query
def s7_low_text_warning(v):
    return layout.low_text_warning(v.spec_documents, v.doc_lines).drop("message")


@query
def s8_code_columns(v):
    return bills.code_columns(_cells(v))


def _cells(v) -> DataFrame:
    """Parts laid out as the cells of one bill per brand: number, code, name, unit."""
    part = v.part.select(
        F.col("p_brand").alias("pair"), F.col("p_partkey").alias("row"),
        F.array(
            F.col("p_size").cast("string"),
            F.when(F.col("p_size") > 5, F.concat(F.col("p_size").cast("string"), F.lit(".2"))).otherwise("code"),
            F.when(F.col("p_size") == 9, "Total HT").otherwise(F.concat(F.lit("- "), "p_name")),
            F.when(F.col("p_type") == "SMALL", "").otherwise(F.lower("p_type")),
        ).alias("cells"),
    )
    return part.select(
        "pair", F.lit(1).alias("sheet"), F.col("row").cast("int").alias("row"), F.posexplode("cells").alias("at", "value")
    ).select("pair", "sheet", "row", (F.col("at") + 1).alias("col"), "value")


@query
def s8_read_reference_bill(v):
    return bills.read_reference_bill(_cells(v))


# ---------------------------------------------------------- scalar functions


@query
def f1_normalize_text(v):
    return v.spec_blocks.select("source_id", "pos", text.normalize_text("text").alias("normalized"))


@query
def f1_normalize_text_full(v):
    return v.spec_blocks.select("source_id", "pos", text.normalize_text_full("text").alias("normalized"))


@query
def f2_clean_block_text(v):
    raw = F.concat(F.lit(" \t"), F.replace("text", F.lit(" "), F.lit(" \u00a0")), F.lit("\u200b\u00a0 "))
    return v.sentences.select("source_id", "pos", text.clean_block_text(raw).alias("cleaned"))


@query
def f3_clean_title(v):
    raw = F.concat(F.lit("- "), "text", F.lit(" ..... "), F.col("n").cast("string"))
    return v.sentences.select("source_id", "pos", text.clean_title(raw).alias("title"))


@query
def f4_code_parts(v):
    raw = F.concat(F.replace("code", F.lit("."), F.lit("-")), F.lit(".-"))
    return v.spec_headings.select(
        "source_id", "pos", codes.normalize_code(raw).alias("code"), _flat(codes.code_parts(raw)).alias("parts"),
        codes.code_level(raw).alias("depth"),
    )


@query
def f5_natural_code_key(v):
    code = F.when(F.col("n") % 4 == 0, F.concat("code", F.lit(".B1"))).otherwise(F.col("code"))
    key = F.transform(codes.natural_code_key(code), lambda k: F.concat_ws(":", k["kind"].cast("string"), k["number"].cast("string"), k["text"]))
    return v.spec_headings.select("source_id", "pos", code.alias("code"), _flat(key).alias("sort_key"))


@query
def f6_style_level(v):
    return v.spec_blocks.select("source_id", "pos", "style", codes.style_level("style").alias("level"))


@query
def f7_heading_level(v):
    code = F.when(F.col("bold"), "3.1-2").otherwise("")
    return v.spec_blocks.select("source_id", "pos", codes.heading_level("style", code).alias("level"))


@query
def f8_pad_lot_code(v):
    raw = F.when(F.col("p_size") > 30, F.concat(F.lit("a"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    return v.part.select("p_partkey", codes.pad_lot_code(raw).alias("lot_code"))


@query
def f9_canonical_unit(v):
    spelled = F.when(F.col("unit") == "m2", "Mètres carrés").when(F.col("unit") == "U", "UNITÉ").otherwise(F.col("unit"))
    return v.typed_lines.select("line_id", units.canonical_unit(spelled).alias("unit"))


@query
def f10_family_unit(v):
    family = F.when(F.col("level") == 1, "vrd").when(F.col("level") == 2, "cvc")
    return v.typed_lines.select("line_id", units.family_unit("unit", family).alias("unit"))


@query
def f11_unit_class(v):
    return v.typed_lines.select("line_id", units.unit_class(F.concat(F.lit(" "), "unit")).alias("unit_class"))


def _stated(v) -> DataFrame:
    context = F.concat(
        F.col("description"),
        F.when(F.col("level") == 1, ". Unité de règlement : m³.").when(F.col("level") == 2, ", u.o. = ml; suite")
        .when(F.col("level") == 3, F.concat(F.lit(" Quantité totale : "), F.col("pos").cast("string"), F.lit(",5 U")))
        .otherwise(" nombre 12 mm, option"),
    )
    return v.typed_lines.withColumn("context", context)


@query
def f12_explicit_unit(v):
    return _stated(v).select("line_id", units.explicit_unit("designation", "context").alias("unit"))


@query
def f13_explicit_quantity(v):
    return _stated(v).select("line_id", units.explicit_quantity("designation", "context").alias("quantity"))


@query
def f14_is_option(v):
    return v.spec_headings.select("source_id", "pos", units.is_option("title").alias("is_option"))


@query
def f15_is_generic_title(v):
    keyed = v.spec_headings.withColumn("title_key", text.normalize_text("title"))
    return keyed.select("source_id", "pos", units.is_generic_title("title_key", normalized=True).alias("is_generic"))


@query
def f16_filename_identity(v):
    identity = codes.filename_identity("original_name")
    return v.spec_documents.select("source_id", identity["code"].alias("code"), identity["title"].alias("title"))


@query
def f17_repeat_key(v):
    raw = F.concat(F.lit("- "), F.col("text"), F.lit(" Page "), F.col("pos").cast("string"), F.lit(" | 3 / 12 "))
    return v.sentences.select("source_id", "pos", text.repeat_key(raw).alias("repeat_key"))


@query
def f18_signature(v):
    return v.spec_headings.select(
        "source_id", "pos", _flat(text.signature("title")).alias("signature"),
        _flat(text.comparison_tokens("title")).alias("tokens"),
    )


@query
def f19_jaccard(v):
    sides = v.typed_lines.select("line_id", text.signature("designation").alias("a"), text.signature("description").alias("b"))
    return sides.select("line_id", text.jaccard("a", "b").alias("overlap"))


def _named_lots(v) -> DataFrame:
    return v.spec_documents.select(
        "dossier_id", F.col("doc_id").alias("lot_order"), F.lit("").alias("project_reference"),
        F.col("dossier_id").alias("project_name"), "lot_code", "lot_title", "source_id",
    )


@query
def f20_output_names(v):
    return contract.output_names(_named_lots(v)).select("source_id", "lot_file")


@query
def f20_sheet_titles(v):
    return contract.sheet_titles(_named_lots(v)).select("source_id", "sheet_title")


@query
def f21_line_depth(v):
    code = F.when(F.col("n") % 7 == 0, "A - lettre").otherwise(F.concat("code", F.lit(".")))
    return v.spec_headings.select("source_id", "pos", codes.line_depth(code, F.col("level") - 1).alias("depth"))


@query
def f22_stable_ids(v):
    return v.spec_headings.select(
        "source_id", "pos", codes.stable_line_id("source_id", "code", "title", "pos").alias("line_id"),
        codes.lot_id("source_id").alias("lot_id"),
    )


@query
def f23_is_dossier_id(v):
    key = F.md5(F.col("o_orderkey").cast("string"))
    raw = F.when(F.col("o_orderstatus") == "F", F.upper(key)).when(F.col("o_orderstatus") == "P", F.substring(key, 1, 31)).otherwise(key)
    return v.orders.select("o_orderkey", text.is_dossier_id(raw).alias("is_id"))


@query
def f24_extract_json_object(v):
    answer = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Voici : ```json\n"), "props", F.lit("\n``` fin {x}")))
        .when(F.col("event_type") == "view", F.concat(F.lit("texte "), "props", F.lit(" suite")))
        .otherwise(F.lit("aucun objet }{"))
    )
    return v.events.select("event_id", text.extract_json_object(answer, "k int")["k"].alias("k"))


@query
def f25_sequence_similarity(v):
    return v.typed_lines.select("line_id", similarity.sequence_similarity("designation", "description").alias("ratio"))


@query
def f26_line_similarity(v):
    return v.typed_lines.select("line_id", similarity.line_similarity("designation", "description").alias("score"))


@query
def f27_line_amount(v):
    items = v.bill_lines.where("kind = 'item'")
    return items.select("source_id", "pos", units.line_amount("quantity", "unit_price").cast("double").alias("amount"))


@query
def f28_display_designation(v):
    return v.typed_lines.select("line_id", units.display_designation("designation", "included", "level").alias("shown"))


@query
def f29_notes(v):
    return v.typed_lines.select(
        "line_id", units.unit_note("unit_source").alias("unit_note"), units.source_note("source_page", "source_excerpt").alias("source_note"),
        units.quantity_note("quantity").alias("quantity_note"),
    )


# ------------------------------------------------------------------- filters


@query
def p1_heading_prefilter(v):
    return headings.heading_prefilter(v.spec_blocks).select("source_id", "pos", "text")


@query
def p2_looks_like_heading(v):
    blocks = v.spec_headings.withColumn("style", F.when(F.col("n") % 8 == 0, "Heading").otherwise("Normal"))
    return blocks.select("source_id", "pos", headings.looks_like_heading("style", "bold", "source_kind", "code").alias("looks"))


@query
def p3_filter_lines(v):
    return overlay.filter_lines(v.typed_lines, "to_review", " RING ").select("line_id")


@query
def p4_search_dossiers(v):
    return overlay.search_dossiers(v.dossiers, "r_5").select("dossier_id")


@query
def p5_drop_sans_objet(v):
    found = cut_lineage(headings.numbered_headings(v.spec_blocks))
    return headings.drop_sans_objet(found, v.spec_blocks).select("source_id", "pos", "code")


def _edited(v) -> DataFrame:
    """Lines as a page might send them: stray texts, odd units, blank names."""
    return v.typed_lines.select(
        "line_id", "source_id", "pos",
        F.when(F.col("kind") == "section", "section").otherwise("poste").alias("kind"),
        (F.col("level") * 3 - 3).alias("level"), F.repeat("code", 20).alias("code"),
        F.when(F.col("confidence") > 0.85, "  ").otherwise(F.repeat("designation", 20)).alias("designation"),
        F.repeat("description", 150).alias("description"), "unit",
        F.when(F.col("confidence") < 0.45, "beaucoup").otherwise(F.col("quantity").cast("string")).alias("quantity"),
        "unit_price", "included", "review_status", F.lit("").alias("origin"),
    )


@query
def p6_sanitize_lines(v):
    clean, _ = overlay.sanitize_lines(_edited(v))
    return clean.drop("unit_price", "pos")


@query
def p6_sanitize_rejects(v):
    _, refused = overlay.sanitize_lines(_edited(v))
    return refused.select("line_id", "quantity")


# ----------------------------------------------------------------- structure


@query
def d1_toc_pages(v):
    return headings.toc_pages(v.spec_blocks)


@query
def d2_lot_identity(v):
    # the cover of half the lots was copied from another
    cover = F.when(F.col("pos") == 1, F.concat(F.lit("CCTP Lot n°"), (F.col("n") % 9 + 1).cast("string"), F.lit(" – Travaux "), "text"))
    blocks = v.sentences.withColumn("text", F.coalesce(cover, F.col("text")))
    return headings.lot_identity(v.spec_documents, blocks)


@query
def d3_numbered_headings(v):
    return headings.numbered_headings(v.spec_blocks).select("source_id", "pos", "code", "title", "level")


@query
def d4_needs_style_numbering(v):
    return headings.needs_style_numbering(v.spec_blocks)


@query
def d5_synthesize_numbering(v):
    return headings.synthesize_numbering(store_step(v.spec_blocks), cut=cut_lineage).select("source_id", "pos", "code", "title", "level")


@query
def d6_score_anchors(v):
    return perimeter.score_anchors(v.spec_headings).select("source_id", "pos", "part", "score")


def _plain_lots(v) -> DataFrame:
    return v.spec_documents.select("source_id", F.lit("vrd").alias("family"), F.lit(None).cast("string").alias("forced_code"))


def _some_anchored(v) -> DataFrame:
    """Headings of which the documents with few sentences open no works chapter."""
    found = v.spec_headings
    sizes = found.groupBy("source_id").agg(F.count("*").alias("rows"))
    title = F.when(F.col("rows") < 20, F.replace("title", F.lit("Description"), F.lit("Chapitre"))).otherwise(F.col("title"))
    return store_step(found.join(sizes, "source_id").withColumn("title", title).drop("rows", "n"))


@query
def d7_select_perimeter(v):
    perimeters, _ = perimeter.select_perimeter(_some_anchored(v), _plain_lots(v), store_step)
    return perimeters.drop("family")


@query
def d7_selected_headings(v):
    _, selected = perimeter.select_perimeter(_some_anchored(v), _plain_lots(v), store_step)
    return selected.select("source_id", "pos", "code")


@query
def d7_forced_and_trade(v):
    """Perimeters confirmed by hand, and those of demolition lots."""
    lots = v.spec_documents.select(
        "source_id",
        F.when(F.col("lot_title") == "Démolition curage", perimeter.DEMOLITION).otherwise("autre").alias("family"),
        F.when(F.col("lot_title") == "Peinture", "2.1").alias("forced_code"),
    )
    found = v.spec_headings.withColumn("title", F.when(F.col("n") % 9 == 0, "Travaux de curage").otherwise(F.col("title"))).drop("n")
    perimeters, selected = perimeter.select_perimeter(store_step(found), store_step(lots), store_step)
    perimeters = cut_lineage(perimeters)
    counted = selected.groupBy("source_id").agg(F.count("*").alias("selected"))
    wanted = perimeters.where(F.col("method").isin("llm_confirmed_anchor", "trade_work_anchor"))
    return wanted.join(counted, "source_id", "left").select("source_id", "method", "anchor_code", "start_page", "selected")


@query
def d8_recover_demolition_items(v):
    parents = F.when(F.col("n") % 3 == 0, "Travaux de curage").when(F.col("n") % 3 == 1, "Installation de chantier").otherwise("Travaux de désamiantage")
    blocks = v.sentences.select(
        "source_id", "pos",
        F.when(F.col("n") % 8 == 0, parents).when(F.col("n") % 7 == 0, "Nature des prestations :")
        .when(F.col("n") % 5 == 0, "Localisation :").when(F.col("n") % 9 == 0, "Base vie de chantier").otherwise(F.col("text")).alias("text"),
        F.lit(None).cast("int").alias("page"), F.when(F.col("n") % 2 == 0, "Default").otherwise("Normal").alias("style"),
        F.lit(10.0).alias("font_size"), F.lit(False).alias("bold"), F.lit("paragraph").alias("source_kind"), "n",
    )
    found = blocks.where(F.col("n") % 8 == 0).select(
        "source_id", "pos", F.concat(F.lit("2."), F.col("pos").cast("string")).alias("code"), F.col("text").alias("title"), F.lit(2).alias("level"),
        "page", "source_kind", "font_size", "bold",
    )
    return headings.recover_demolition_items(cut_lineage(found), blocks.drop("n"), cut_lineage).select("source_id", "pos", "code", "title", "level")


@query
def d9_renumber_under(v):
    return headings.renumber_under(v.spec_headings.drop("n")).select("source_id", "pos", "code", "level")


@query
def d10_dedupe_headings(v):
    return headings.dedupe_headings(v.spec_headings.drop("n"), store_step).select("source_id", "pos", "code", "code_conflict")


@query
def d11_attach_context(v):
    # stored: a filter on a text that is worked out would work it out again for each of its tests
    blocks = store_step(v.spec_blocks)
    found = cut_lineage(headings.numbered_headings(blocks))
    return lines.attach_context(found, blocks).select("source_id", "pos", "context", "is_void")


def _typed_headings(v) -> DataFrame:
    placed = ordered.following(v.spec_headings, ["source_id"], "pos", ["pos", "code", "level"], "next")
    facts = placed.withColumns(
        {"family": F.lit("vrd"), "method": F.lit("explicit_anchor"), "anchor_code": F.lit("2"), "perimeter_confidence": F.lit(0.98)}
    )
    return lines.type_lines(facts)


@query
def d12_type_lines(v):
    return _typed_headings(v).select("source_id", "pos", "kind", "is_anchor")


@query
def d13_drop_generic_items(v):
    keyed = _typed_headings(v).withColumn("title_key", text.normalize_text("title"))
    return lines.drop_generic_items(keyed).select("source_id", "pos")


@query
def d14_score_lines(v):
    scored = lines.score_lines(
        v.spec_headings.withColumns({
            "kind": F.when(F.col("level") == 1, "section").otherwise("item"),
            "perimeter_confidence": F.when(F.col("n") % 4 == 0, 0.78).otherwise(0.98),
            "unit_confidence": F.when(F.col("n") % 3 == 0, 0.62).otherwise(0.88),
            "unit_source": F.when(F.col("n") % 3 == 0, "default").otherwise("rule"),
            "code_conflict": F.col("n") % 7 == 0,
        })
    )
    return scored.select("source_id", "pos", "confidence", "review_reason", "review_status", _flat(F.col("review_fields")).alias("review_fields"))


@query
def d16_list_headings(v):
    return headings.list_headings(store_step(v.spec_blocks), cut_lineage)


def _extraction(v):
    return extract_lines(v.spec_documents, store_step(v.spec_blocks))


@query
def d15_document_warnings(v):
    return _extraction(v).warnings


@query
def d17_extract_lines(v):
    return _extraction(v).lines.withColumn("review_fields", _flat(F.col("review_fields")))


# ---------------------------------------------------------------------- rules


@query
def r1_classify_family(v):
    found = units.classify_family("title_key", normalized=True)
    keyed = v.spec_documents.withColumn("title_key", text.normalize_text("lot_title"))
    return keyed.select("source_id", found["family"].alias("family"), found["rank"].alias("family_rank"))


@query
def r2_infer_unit(v):
    family = F.when(F.col("level") == 1, "vrd").when(F.col("level") == 2, "cvc").otherwise("peinture")
    found = units.infer_unit("title", F.lit(""), family, "title_key")
    return v.spec_headings.withColumn("title_key", text.normalize_text("title")).withColumn("found", found).select(
        "source_id", "pos", F.col("found.unit").alias("unit"), F.col("found.source").alias("unit_source"), F.col("found.confidence").alias("unit_confidence")
    )


@query
def r3_mine_rules(v):
    return enrich.mine_rules(v.typed_lines, min_support=15, min_purity=0.15, min_projects=3)


@query
def r4_flag_co_occurrence(v):
    typed = v.typed_lines
    return enrich.flag_co_occurrence(
        typed.select("project", F.col("description").alias("concept")), typed.select("project", F.col("designation").alias("extra")), 3
    )


def _bill_of_headings(v) -> DataFrame:
    """Headings as bill lines of VRD and other lots."""
    kind = F.when(F.col("level") <= 2, "section").otherwise("item")
    return v.spec_headings.select(
        "source_id", F.col("pos").cast("bigint").alias("pos"), F.concat_ws("_", F.lit("ln"), "source_id", "pos").alias("line_id"),
        kind.alias("kind"), "level", "code", F.col("title").alias("designation"), F.lit("").alias("description"),
        F.when(kind == "item", "Ens").alias("unit"), F.lit("rule").alias("unit_source"), F.lit(0.8).alias("unit_confidence"),
        F.lit(None).cast("double").alias("quantity"), F.lit("missing").alias("quantity_source"),
        F.lit(None).cast("double").alias("unit_price"), F.lit(True).alias("included"), F.lit(0.9).alias("confidence"),
        F.lit("validated").alias("review_status"), F.lit("").alias("review_reason"), F.array().cast("array<string>").alias("review_fields"),
        F.col("page").alias("source_page"), F.lit("").alias("source_excerpt"), F.lit("deterministic-v2").alias("origin"),
        F.lit(False).alias("user_edited"),
    )


def _trade_lots(v) -> DataFrame:
    family = units.classify_family("title_key", normalized=True)["family"]
    keyed = v.spec_documents.withColumn("title_key", text.normalize_text("lot_title"))
    return keyed.select("source_id", F.when(F.col("extension") == ".docx", "vrd").otherwise(family).alias("family"))


@query
def e1_decomposition_triggers(v):
    found = enrich.decomposition_triggers(_bill_of_headings(v))
    return found.select("source_id", "rule", F.col("trigger.pos").alias("pos"), F.col("trigger.level").alias("level"))


@query
def e1_apply_decomposition(v):
    return enrich.apply_decomposition(store_step(_bill_of_headings(v)), store_step(_trade_lots(v)), store_step).select(
        "source_id", "pos", "line_id", "designation", "level", "unit", "origin"
    )


@query
def e2_skeleton_anchors(v):
    return enrich.skeleton_anchors(_bill_of_headings(v), "vrd").select(
        "source_id", "chapter", F.col("anchor.anchor_order").alias("pos"), F.col("anchor.score").alias("score")
    )


@query
def e2_apply_skeleton(v):
    return enrich.apply_skeleton(store_step(_bill_of_headings(v)), store_step(_trade_lots(v)), store_step).select(
        "source_id", "pos", "line_id", "designation", "level", "unit", "origin"
    )


def _part_lots(v) -> DataFrame:
    return v.part.select(F.col("p_brand").alias("source_id")).distinct().withColumn(
        "family", F.when(F.col("source_id").endswith("1"), "vrd").otherwise("cvc")
    )


@query
def e3_fill_missing_units(v):
    asked = v.part.select(
        F.concat(F.lit("ln_"), F.col("p_partkey").cast("string")).alias("line_id"),
        F.when(F.col("p_size") > 40, "tonne").when(F.col("p_size") > 20, "Ens").otherwise("kg").alias("unit"),
    )
    return enrich.fill_missing_units(v.typed_lines, asked, _part_lots(v)).select("line_id", "unit", "unit_source", "unit_confidence")


@query
def e4_retry_perimeter(v):
    blocks = store_step(v.spec_blocks)
    first = extract_lines(v.spec_documents, blocks)
    guess = v.spec_documents.select("source_id", F.lit("2.1").alias("anchor_code"))
    again = retry_perimeter(v.spec_documents, blocks, first, guess)
    return again.perimeters.select("source_id", "method", "anchor_code", "selected_heading_count")


@query
def e5_merge_refinements(v):
    size = F.col("p_size")
    asked = v.part.select(
        F.col("p_brand").alias("source_id"), F.col("p_partkey").alias("seq"),
        F.when(size <= 25, F.concat(F.lit(" "), (F.lit(1) + size % 9).cast("string"), F.lit("."), F.col("p_partkey").cast("string"))).alias("code"),
        F.when(size <= 25, F.concat(F.lit("Précisé "), "p_name")).otherwise(F.concat(F.upper("p_name"), F.lit(" "), F.lower("p_type"))).alias("designation"),
        F.when(size > 10, "Ens").otherwise("palette").alias("unit"), (size.cast("double") / 40).alias("confidence"),
        F.when(size > 45, "À revoir").alias("review_reason"), F.when(size < 5, F.col("p_name")).alias("source_excerpt"),
    )
    return enrich.merge_refinements(v.typed_lines, asked, _part_lots(v)).select(
        "line_id", "designation", "unit", "unit_source", "unit_confidence", "confidence", "review_status", "review_reason", "source_excerpt", "origin"
    )


@query
def d17_reprocess(v):
    """Every sixth document rewritten since it was stored: what is extracted again, what of the others stays."""
    documents, before = v.spec_documents, store_step(v.spec_blocks)
    stored = reprocess.content_facts(documents, before).select("source_id", "content_hash")
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("bigint")
    now = store_step(before.withColumn("text", F.when((number % 6 == 0) & (F.col("pos") == 1), F.concat("text", F.lit(" Modifié"))).otherwise(F.col("text"))))
    held = store_step(_bill_of_headings(v).withColumn("user_edited", F.col("pos") % 5 == 0).withColumn("designation", F.when(F.col("pos") % 5 == 0, F.upper("designation")).otherwise(F.col("designation"))))
    done = reprocess.reprocess(documents, now, stored, held)
    edited = done.lines.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("user_edited").alias("edited"))
    kept = lambda c: F.when(~F.col("changed"), F.coalesce(c, F.lit(0)))
    return store_step(done.facts.join(edited, "source_id", "left").select(
        "source_id", "changed", "character_count", "page_count", kept("n").alias("kept_lines"), kept("edited").alias("kept_edits"),
        F.when(~F.col("changed"), F.col("status")).alias("kept_status"),
    ))


# ---------------------------------------------------------------------- joins


@query
def j1_overlay_edits(v):
    return overlay.overlay_edits(v.typed_lines, v.previous_lines).select(
        "line_id", "source_id", "pos", "designation", "unit", "included", "user_edited", "origin"
    )


@query
def j2_detect_edits(v):
    return overlay.detect_edits(v.typed_lines, v.previous_lines).select("line_id", "user_edited")


@query
def j3_visible_dossiers(v):
    return overlay.visible_dossiers(v.dossiers, v.shares, "42", " User3@Example.com ").select(
        "dossier_id", "owner_sub", "shared_permission", "updated_at"
    )


@query
def j3_searched_dossiers(v):
    return overlay.visible_dossiers(v.dossiers, v.shares, "42", "user3@example.com", "projet 1").select("dossier_id", "project_name")


@query
def j4_shared_vocabulary(v):
    return evaluate.shared_vocabulary(v.gen_lines, v.ref_lines, 0.24)


@query
def j4_similar_line_pairs(v):
    return evaluate.similar_line_pairs(v.gen_lines, v.ref_lines)


def _matches(v) -> DataFrame:
    return evaluate.match_one_to_one(evaluate.similar_line_pairs(v.gen_lines, v.ref_lines), v.gen_lines, v.ref_lines)


@query
def j5_match_one_to_one(v):
    return _matches(v)


@query
def j5_match_by_vocabulary(v):
    """The same matching over likenesses that need no Python: shared vocabulary, told apart by the lengths of the texts."""
    near = evaluate.shared_vocabulary(v.gen_lines, v.ref_lines, 0.4)
    apart = (F.length("gen_text") * 7 + F.length("ref_text") * 13) % 101
    pairs = near.select("pair", "gen_text", "ref_text", (F.col("overlap") + apart.cast("double") / 1000).alias("score"))
    return evaluate.match_one_to_one(pairs, v.gen_lines, v.ref_lines)


def _key_matches(v) -> DataFrame:
    """Matches that need no likeness: parts of one brand, size apart and price in step."""
    left = v.gen_lines.groupBy("pair", "designation").agg(F.max("gen_index").alias("gen_index"))
    right = v.ref_lines.groupBy("pair", "designation").agg(F.max("ref_index").alias("ref_index"))
    return left.join(right, ["pair", "designation"]).select("pair", "gen_index", "ref_index", F.lit(1.0).alias("score"))


@query
def j6_unmatched(v):
    left_gen, left_ref = evaluate.unmatched(v.gen_lines, v.ref_lines, _key_matches(v))
    side = lambda df, name, c: df.select("pair", F.lit(name).alias("side"), F.col(c).alias("line_index"), "designation")
    return side(left_gen, "generated", "gen_index").unionByName(side(left_ref, "reference", "ref_index"))


@query
def j7_following_heading(v):
    found = cut_lineage(headings.numbered_headings(v.spec_blocks))
    placed = ordered.following(found, ["source_id"], "pos", ["pos", "code"], "next")
    return placed.select("source_id", "pos", F.col("next.pos").alias("next_pos"), F.col("next.code").alias("next_code"))


# --------------------------------------------------------------- aggregations


@query
def a1_quality_stats(v):
    return stats.quality_stats(v.typed_lines, ["project"])


def _dossier_tables(v):
    dossiers = v.customer.select(F.col("c_custkey").cast("string").alias("dossier_id"))
    lots = v.orders.select(F.col("o_custkey").cast("string").alias("dossier_id"), F.col("o_orderkey").cast("string").alias("source_id"))
    items = v.lineitem.select(
        F.col("l_orderkey").cast("string").alias("source_id"), F.when(F.col("l_returnflag") == "N", "section").otherwise("item").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "validated").otherwise("to_review").alias("review_status"),
    )
    return dossiers, lots, items


@query
def a2_dossier_summary(v):
    dossiers, lots, items = _dossier_tables(v)
    return stats.dossier_summary(dossiers, lots, lots, items)


@query
def a3_dossier_status(v):
    dossiers, lots, items = _dossier_tables(v)
    summary = stats.dossier_summary(dossiers, lots, lots, items)
    running = summary.withColumn("done_count", F.when(F.col("document_count") % 3 == 0, F.floor(F.col("document_count") / 2)).otherwise(F.col("document_count")))
    return stats.dossier_status(running).select("dossier_id", "status", "progress")


@query
def a4_bill_totals(v):
    totals = rollup.bill_totals(v.bill_lines)
    money = [c for c in totals.columns if c != "source_id"]
    return totals.select("source_id", *[F.round(c, 2).cast("double").alias(c) for c in money])


@query
def a4_bill_rollup(v):
    # the bills are read several times: stored once, as they would be
    rows = rollup.bill_rollup(store_step(v.bill_lines))
    return rows.select("source_id", "row_kind", "code", F.round("amount", 2).cast("double").alias("amount"))


@query
def a4_bill_rows(v):
    rows = rollup.bill_rows(cut_lineage(v.priced_lines), v.spec_documents)
    return rows.select(*[F.round(c, 2).cast("double").alias(c) if c == "amount" else F.col(c) for c in rows.columns])


@query
def a5_evaluate_pairs(v):
    return evaluate.evaluate_pairs(v.gen_lines, v.ref_lines, _key_matches(v))


@query
def a5_evaluate_corpus(v):
    return evaluation.evaluate_corpus(v.gen_lines, v.ref_lines).by_pair


@query
def a6_evaluate_total(v):
    return evaluate.evaluate_total(evaluate.evaluate_pairs(v.gen_lines, v.ref_lines, _key_matches(v)))


@query
def a7_unit_source_counts(v):
    return evaluate.unit_source_counts(v.gen_lines)


@query
def a8_portfolio_totals(v):
    orders = v.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "ready").otherwise("needs_review").alias("status"))
    per_order = v.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.countDistinct("l_suppkey").alias("lot_count"), F.count("*").alias("line_count")
    )
    held = orders.join(per_order, "o_orderkey", "left").select("o_custkey", "status", "lot_count", "line_count")
    return stats.portfolio_totals(held, ["o_custkey"])


@query
def a9_lot_counters(v):
    _, _, items = _dossier_tables(v)
    return stats.lot_counters(items)


# ------------------------------------------------------------- sorts, outputs


@query
def o1_order_lots(v):
    lots = v.spec_documents.select("source_id", "lot_code", "lot_title")
    keyed = listing.lot_order(lots)
    # lots of equal keys share the place of the first of them
    keys = ["code_key", "family_rank", "title_key"]
    stood = ordered.ranked(keyed, [], [*keys, "source_id"], "at")
    places = stood.groupBy(*keys).agg(F.min("at").cast("int").alias("place"))
    return keyed.join(places, keys).select(
        "source_id", F.get("code_key", F.lit(0))["number"].cast("int").alias("code_number"), "family_rank", "title_key", "place"
    )


@query
def o2_insert_by_code(v):
    known = v.typed_lines.where("kind = 'item'")
    new = v.typed_lines.where("kind = 'section'").withColumn("line_id", F.concat(F.lit("new_"), "line_id"))
    return overlay.insert_by_code(known, new).select("line_id", "source_id", "pos")


@query
def o3_newest_first(v):
    return overlay.newest_first(v.dossiers).select("dossier_id", "updated_at")


@query
def o4_top_examples(v):
    left_gen, _ = evaluate.unmatched(v.gen_lines, v.ref_lines, _key_matches(v))
    return listing.top_examples(left_gen, ["pair"], ["gen_index"], evaluation.UNMATCHED).select("pair", "gen_index", "designation")


@query
def k1_export_contract(v):
    lots = v.spec_documents.select(
        F.regexp_replace("source_id", "src_", "").alias("dossier_id"), "source_id", "lot_code", "lot_title"
    )
    made = contract.export_contract(v.dossiers, lots, _bill_of_headings(v))
    return made.select("*", "project.name", "project.reference", "project.client").drop("project")


@query
def k2_export_rows(v):
    """What is read back from the output of each lot, after writing it twice."""
    named = contract.output_names(_named_lots(v)).select("source_id", "lot_file")
    with passing_steps() as keep:
        rows = keep(rollup.bill_rows(store_step(v.priced_lines), v.spec_documents).join(named, "source_id").drop("source_id"))
    path = f"{checkpoint_folder(rows.sparkSession)}/lots-{uuid.uuid4().hex}"
    for _ in range(2):
        listed = contract.export_lots(rows, path)
    stored = contract.read_lots(rows.sparkSession, path, rows.schema)
    held = stored.groupBy("lot_file").agg(
        F.count("*").alias("n_rows"), F.max("row_no").alias("last_row"), F.count_if(F.col("row_kind") == "subtotal").alias("n_subtotals"),
        F.round(F.max(F.when(F.col("row_kind") == "total_ttc", F.col("amount"))), 2).cast("double").alias("total_ttc"),
    )
    return store_step(held.join(listed.groupBy("lot_file").agg(F.sum("rows").alias("listed_rows")), "lot_file"))


@query
def k3_snapshot_revision(v):
    """What is read back after writing one stamp twice."""
    lines = v.typed_lines
    path = f"{checkpoint_folder(lines.sparkSession)}/revisions-{uuid.uuid4().hex}"
    for _ in range(2):
        contract.snapshot_revision(lines, "2024-01-01T00:00:00Z", path)
    stored = lines.sparkSession.read.schema(lines.schema.add("revision", "string")).parquet(path)
    return stored.select("revision", "line_id", "designation")


