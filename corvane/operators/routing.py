"""Rule routing of questions: high risk, out of scope, to be clarified, or answerable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import content_words, stem, stemmed_words

# Rules (fixed values): first match wins; pattern and reason.
HIGH_RISK = (
    (r"(?i)(?<![/\w])\d+(?:\.\d+)?\s?(?:kg|kgs|kilos?|kilograms?)\b(?!\s*/)", "patient's weight"),
    (r"(?i)\bweigh(?:s|ing)\b|\bweight\s+(?:is|of)\s+\d", "patient's weight"),
    (r"(?i)\b(?:calculate|work\s+out|compute)\b.*\b(?:dose|rate|volume|infusion|bolus|ml|units|mg)\b", "dose calculation"),
    (r"(?i)\bhow\s+(?:much|many)\s+(?:mg|mcg|ml|mls|units|g|vials?|ampoules?|tablets?)\b[^?.]*\b(?:should|shall|do|can|to)\s+(?:i|we|give|use|draw)\b", "dose calculation"),
    (r"(?i)\bwhat\s+(?:rate|dose)\s+should\s+(?:i|we)\s+(?:set|give|run|use|start)\b", "dosing decision"),
    (r"(?i)\bshould\s+(?:i|we)\s+(?:give|start|stop|withhold|hold|continue|restart|increase|decrease|prescribe|transfuse|intubate|discharge|treat|switch|escalate|de-?escalate)\b", "treatment decision"),
    (r"(?i)\b(?:does|do)\s+(?:he|she|my\s+patient|this\s+patient|the\s+patient)\s+have\b|\bdiagnos(?:e|is)\b", "diagnosis"),
    (r"(?i)\b(?:creatinine|egfr|crcl|creatinine\s+clearance|urea|bilirubin)\s*(?:is|of|=|:|at|was)?\s*\d", "laboratory value"),
)
PATIENT = (
    r"(?i)\b(?:my|this|our|his|her)\s+(?:patient|pt|baby|infant|child|kid|mother|lady|gentleman|man|woman|boy|girl)(?:['’]s)?\b|\bpatient['’]s\b|\b(?:he|she)\s+(?:is|has|was|weighs)\b|"
    r"\b(?:for|give|giving|to|on)\s+(?:him|her)\b|\bin\s+bed\s*(?:no\.?\s*)?\d+|\bbed\s*(?:no\.?\s*)?\d+\b|\b\d{1,3}\s*[- ]?(?:year|yr|month|day)s?[- ]old\b|<PERSON>|<MRN>|<ABHA>|<ID_NUMBER>|<DOB>"
)
DECISION = (
    r"(?i)\b(?:dose|doses|dosing|rate|mg|mcg|units?|ml|mls|give|start|stop|withhold|hold|continue|increase|decrease|titrate|adjust|prescribe|transfuse|intubate|discharge|treat|treatment|safe|okay|ok|diagnos\w*|have)\b"
)
OFF_TOPIC = (
    r"(?i)\b(?:weather|cricket|football|ipl|movie|film|song|lyrics|recipe|joke|poem|stock|share\s+price|bitcoin|crypto|election|politic\w*|news|python|javascript|java|code|coding|program|sql|excel|translate|"
    r"horoscope|capital\s+of|who\s+won|write\s+(?:me\s+)?an?\s+(?:essay|story|email))\b"
)
GREETING = r"(?i)^\s*(?:hi|hello|hey|thanks|thank\s+you|good\s+(?:morning|evening|night)|ok|okay)\b[\s!.?]*$"
VAGUE = r"(?i)^\s*(?:how\s+(?:much|many|long|often)|what\s+(?:dose|rate|amount))\b"
QUANTITY_WORDS = "much many long often amount give use need".split()
GENERIC_WORDS = "dose doses dosing rate protocol policy guideline drug medicine number contact who call time rule rules".split()


#: Words that show a question to be about the field, also beside "news" or "code".
DOMAIN_WORDS = (
    "dose dosing infusion bolus protocol guideline circular policy sop patient patients ward icu emergency sepsis septic transfusion antibiotic antimicrobial medication medicine drug aptt "
    "nomogram escalation resuscitation cardiac arrest bleeding haemorrhage news2 pager extension blood mtp outreach ccot lactate oxygen fluid fluids"
).split()
CLARIFY = "Which medicine, protocol or situation is this about?"


def route(questions: DataFrame, lexicon: list[str], domain: list[str] = DOMAIN_WORDS, text_col: str = "question") -> DataFrame:
    """Questions with ``route``, ``reason`` and ``clarifying_question``. ``lexicon``: stems of entities; ``domain``: words of the field."""
    q = F.col(text_col)
    reason = F.lit(None).cast("string")
    for pattern, why in reversed(HIGH_RISK):
        reason = F.when(q.rlike(pattern), F.lit(why)).otherwise(reason)
    words, stems = content_words(q), stemmed_words(q)
    array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    entity = F.arrays_overlap(stems, array(list(lexicon)))
    field = entity | F.arrays_overlap(stems, F.transform(array(list(domain)), stem))
    specific = F.array_except(words, array([*GENERIC_WORDS, *QUANTITY_WORDS]))
    general = (F.size(words) > 0) & (F.size(F.array_except(words, array(GENERIC_WORDS))) == 0)
    vague = q.rlike(VAGUE) & (F.size(specific) <= 1) & ~entity
    routed = (
        F.when(reason.isNotNull(), F.struct(F.lit("high_risk").alias("route"), reason.alias("reason")))
        .when(q.rlike(PATIENT) & q.rlike(DECISION), F.struct(F.lit("high_risk").alias("route"), F.lit("specific patient").alias("reason")))
        .when(q.rlike(GREETING) | (q.rlike(OFF_TOPIC) & ~field), F.struct(F.lit("out_of_scope").alias("route"), F.lit("not about the documents").alias("reason")))
        .when(general | vague, F.struct(F.lit("clarify").alias("route"), F.lit("too general").alias("reason")))
        .otherwise(F.struct(F.lit("answer").alias("route"), F.lit("document lookup").alias("reason")))
    )
    asks = F.when(F.col("routed.route") == "clarify", CLARIFY)
    return questions.withColumn("routed", routed).withColumns({"route": F.col("routed.route"), "reason": F.col("routed.reason"), "clarifying_question": asks}).drop("routed")
