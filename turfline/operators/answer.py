"""Question answering over whole tables of questions: predictions for named
players, retrieval-backed prompts, intent routing and display records.

One job answers every question: intent is a column, each branch runs on its
subset, and the branches are joined back on the question id. The retrieval
branch stops at the assembled prompt (no hosted model call).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline import constants as K
from turfline.functions.columns import round_half_even
from turfline.operators import text as TX
from turfline.operators import vectors as VX
from turfline.operators.scoring import classify_advice
from turfline.operators.windows import last_n_turns
from turfline.plans.guards import looked_up, reuse

NOT_FOUND_NEWS = K.NOT_FOUND_NEWS
NOT_FOUND_ADVICE = K.NOT_FOUND_ADVICE
CONTEXT_HEADER = "Known facts:\n"
SYSTEM_INSTRUCTION = (
    "Answer the manager's question from the facts listed with it and from nothing else. "
    "Say what to do, then why, then what could go wrong, one line each. "
    "Where the facts do not settle the question, say which fact is missing."
)


def predict_for_questions(questions: DataFrame, scored: DataFrame, query_col: str = "query",
                          id_col: str = "query_id") -> DataFrame:
    """Question -> longest matching player name -> prediction (1 dp, >= 0) -> advice.

    ``scored``: web_name, raw_pred, position_name, has_injury_news, is_available, and id (the table's
    order) and minutes where there are such columns. Only players with minutes can be meant; of
    equally long names the first in the table is. Players who share a name count once
    (``one_per_name``), so a question has one answer. Questions without a match get the not-found record."""
    if "minutes" in scored.columns:
        scored = scored.where(F.col("minutes") > 0)
    scored = one_per_name(scored)
    order = "id" if "id" in scored.columns else None
    match = TX.match_entity_longest(questions, scored, query_col, "web_name", id_col, order)
    j = questions.select(id_col, query_col).join(match, id_col)
    # Unmatched questions (NULL name) bypass the lookup; those of one frequent name are dealt to parts.
    players = scored.select(F.col("web_name").alias("matched"), "raw_pred", "position_name", "has_injury_news", "is_available")
    hit = looked_up(j.where(F.col("matched").isNotNull()), "matched", players)
    miss = j.where(F.col("matched").isNull())
    j = hit.unionByName(miss, allowMissingColumns=True)
    xp = F.greatest(round_half_even("raw_pred", 1), F.lit(0.0))
    j = j.withColumn("xp", xp)
    found = F.col("matched").isNotNull()
    news = F.concat(F.lit(K.EXPECTED_NEWS[0]), F.col("xp").cast("string"), F.lit(K.EXPECTED_NEWS[1]))
    advice = classify_advice("xp", "position_name", "has_injury_news", "is_available")
    return j.select(
        id_col,
        F.when(found, F.col("matched")).otherwise(F.col(query_col)).alias("player"),
        F.when(found, F.col("xp")).alias("predicted_points"),
        F.when(found, news).otherwise(F.lit(NOT_FOUND_NEWS)).alias("news"),
        F.when(found, advice).otherwise(F.lit(NOT_FOUND_ADVICE)).alias("advice"))


def one_per_name(scored: DataFrame, name: str = "web_name") -> DataFrame:
    """One row for each name: the smallest by the other columns, ``id`` first if there is one.
    A partial aggregate, so a name that many rows share is reduced before the shuffle."""
    rest = sorted((c for c in scored.columns if c != name), key=lambda c: c != "id")
    if not rest:
        return scored.distinct()
    return scored.groupBy(name).agg(F.min(F.struct(*rest)).alias("_r")).select(name, "_r.*")


def retrieve_context(index: DataFrame, questions: DataFrame, k: int = K.ANSWER_K,
                     id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """Per question: bulleted context lines in rank order ('- ' + chunk)."""
    q = VX.embed_text(questions.select(id_col, query_col), query_col)
    q = q.withColumn("name", TX.detect_proper_noun(query_col))
    corpus = index.select("doc_id", "embedding", "name", "page_content")
    hits = VX.retrieve_hybrid(corpus, q, k, query_id=id_col, doc_id="doc_id", filter_col="name",
                              content_col="page_content")
    hits = reuse(hits)  # read by the id probe and by the join
    lines = hits.join(VX.fetch_by_ids(corpus, hits, "doc_id", ["page_content"], VX.MAX_BROADCAST_QUERIES * k), "doc_id")
    ctx = lines.groupBy(id_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "page_content"))),
                                 lambda x: F.concat(F.lit("- "), x["page_content"])), "\n").alias("context"),
        F.count(F.lit(1)).alias("n_context"))
    return questions.select(id_col).join(ctx, id_col, "left").fillna({"context": "", "n_context": 0})


def assemble_prompt(questions: DataFrame, contexts: DataFrame, history: DataFrame,
                    id_col: str = "query_id", query_col: str = "query",
                    instruction: str = SYSTEM_INSTRUCTION) -> DataFrame:
    """Messages: system, last-n history turns, then the context + question."""
    j = questions.select(id_col, query_col).join(contexts, id_col, "left").join(
        history.select(id_col, "history"), id_col, "left")
    human = F.concat(F.lit(CONTEXT_HEADER), F.coalesce(F.col("context"), F.lit("")),
                     F.lit("\n\nQuestion: "), F.col(query_col))
    sys_msg = F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content"))
    hum_msg = F.struct(F.lit("human").alias("role"), human.alias("content"))
    msgs = F.concat(F.array(sys_msg), F.coalesce(F.col("history"), F.array().cast("array<struct<role:string,content:string>>")),
                    F.array(hum_msg))
    return j.select(id_col, query_col, "context", "n_context", human.alias("prompt"), msgs.alias("messages"))


def route_batch(messages: DataFrame, index: DataFrame, scored: DataFrame,
                id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """Per user question: intent, then the ``ml`` struct, the ``rag`` struct, or both."""
    hist = last_n_turns(messages, K.HISTORY_TURNS, text_col=query_col)
    qs = messages.where(F.col("role") == "user").select(id_col, query_col)
    qs = qs.withColumn("intent", TX.classify_intent(query_col))
    ml_q = qs.where(F.col("intent").isin("ml", "both"))
    rag_q = qs.where(F.col("intent").isin("rag", "both"))
    ml = predict_for_questions(ml_q, scored, query_col, id_col)
    ml = ml.select(id_col, F.struct("player", "predicted_points", "news", "advice",
                                    F.lit("ml").alias("_type")).alias("ml"))
    ctx = retrieve_context(index, rag_q, K.ANSWER_K, id_col, query_col)
    prompts = assemble_prompt(rag_q, ctx, hist, id_col, query_col)
    rag = prompts.select(id_col, F.struct(F.col(query_col).alias("player"),
                                          F.lit(None).cast("double").alias("predicted_points"),
                                          F.col("context").alias("news"), F.lit(None).cast("string").alias("advice"),
                                          F.lit("rag").alias("_type"), "prompt", "messages").alias("rag"))
    return qs.join(ml, id_col, "left").join(rag, id_col, "left")


def shape_response(routed: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Display record: combined when both branches ran, news-only when there is
    news but no prediction, else the prediction card."""
    ml, rag = F.col("ml"), F.col("rag")
    pts = F.coalesce(ml["predicted_points"].cast("string"), F.lit("?"))
    combined = F.concat(F.lit(K.LABEL_PREDICTION), ml["player"], F.lit(": "), pts, F.lit(K.LABEL_ANALYSIS),
                        F.coalesce(rag["news"], F.lit("")))
    def pick(field: str) -> Column:
        return F.when(ml.isNotNull(), ml[field]).otherwise(rag[field])

    news_only = pick("predicted_points").isNull() & pick("news").isNotNull()
    card = F.concat(F.lit("**"), pick("player"), F.lit("** — "),
                    F.coalesce(pick("predicted_points").cast("string"), F.lit("?")), F.lit(" pts\n"),
                    F.coalesce(pick("advice"), F.lit("")))
    kind: Column = (F.when(ml.isNotNull() & rag.isNotNull(), F.lit("combined"))
                    .when(news_only, F.lit("news")).otherwise(F.lit("card")))
    text = (F.when(ml.isNotNull() & rag.isNotNull(), combined)
            .when(news_only, pick("news")).otherwise(card))
    return routed.select(id_col, "intent", kind.alias("kind"), text.alias("display_text"))


def serving_players(names: DataFrame) -> DataFrame:
    """Stand-in scored rows for a name dictionary (prediction and status derived
    from the name), used where the oracle needs predictions without a model."""
    n = F.length("web_name")
    pos = F.element_at(F.array(*[F.lit(p) for p in K.POSITIONS]), (n % 4 + 1).cast("int"))
    return names.select(
        "web_name", "id", "minutes",
        (((n * 7) % 81).cast("double") / 10.0 - 0.5).alias("raw_pred"),
        pos.alias("position_name"),
        F.when(n % 5 == 0, 1).otherwise(0).alias("has_injury_news"),
        (n % 7 != 0).alias("is_available"))
