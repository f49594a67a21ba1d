"""What goes to a language model and what comes back: settings, requests, formats to fall back on, corrections, mapping to profiles.

The model itself is a callable of the user's (adapters.Provider takes a request as JSON and gives the completion's JSON).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.cluster import ship
from folioforge.functions.text import estimate_tokens, strip

from . import repair
from .document import PROFILE, as_profiles
from .prompt import layout_transcript, page_text

#: Ways to show a document, to ask for evidence, and what to ask for. Fixed values.
REPRESENTATIONS = ("layout-transcript", "layout-native", "canonical-text")
EVIDENCE_MODES = ("baseline", "entity-bound")
CONTRACTS = ("optional", "required-initial")
SCOPES = ("full", "entities-only", "entity-inventory")
ENTITIES = ("experiences", "projects", "education")
SAMPLING = {"temperature": 0.1, "top_p": 0.95, "max_tokens": 3000}
#: How a request is nudged once when the answer repeats itself.
NUDGE = {"temperature": 0.2, "frequency_penalty": 0.2}
CORRECTION = (
    "The JSON above is not valid. Fields at fault: {paths}. Keep every entry of experiences, projects and education with its content, "
    "and no collection shorter than it is; mend only these fields, with null or [] for optional ones. Answer with JSON alone."
)


@dataclass(frozen=True)
class Settings:
    """One provider's settings; combinations that make no sense are refused."""

    model: str
    representation: str = "layout-transcript"
    evidence_mode: str = "baseline"
    contract: str = "optional"
    scope: str = "full"
    retries: int = 2
    timeout_seconds: float = 45.0
    sampling: Mapping[str, float] = field(default_factory=lambda: dict(SAMPLING))

    def __post_init__(self) -> None:
        for value, known in ((self.representation, REPRESENTATIONS), (self.evidence_mode, EVIDENCE_MODES), (self.contract, CONTRACTS), (self.scope, SCOPES)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")
        if self.contract == "required-initial" and self.scope != "entities-only":
            raise ValueError("required-initial evidence goes with the scope entities-only")
        if self.scope == "entity-inventory" and (self.evidence_mode != "baseline" or self.contract != "optional"):
            raise ValueError("entity-inventory asks for no evidence")


def key_from_environment(name: str, environment: Mapping[str, str] | None = None, file: str | None = None) -> str:
    """A key from the environment, else from a file of NAME=value lines on the driver; it never becomes part of a plan."""
    found = (environment if environment is not None else os.environ).get(name, "").strip()
    if not found and file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            found = next((v.strip().strip("\"'") for k, _, v in (line.partition("=") for line in f) if k.strip() == name), "")
    if not found:
        raise ValueError(f"{name} is not set")
    return found


def pruned_schema(schema: dict, scope: str) -> dict:
    """A JSON schema with only what a scope asks for: entries alone, or entries without their evidence and lists of lines."""
    if scope == "full":
        return schema
    out = json.loads(json.dumps(schema))
    out["properties"] = {k: v for k, v in out.get("properties", {}).items() if k in ENTITIES}
    out["required"] = [k for k in out.get("required", []) if k in ENTITIES]
    if scope == "entity-inventory":
        for holder in (*out["properties"].values(), *out.get("$defs", {}).values()):
            items = holder.get("items", holder)
            for gone in ("evidence", "description", "achievements", "skills", "coursework"):
                items.get("properties", {}).pop(gone, None)
            if "required" in items:
                items["required"] = [r for r in items["required"] if r in items.get("properties", {})]
    return out


def shown(blocks: DataFrame, representation: str) -> DataFrame:
    """(doc_id, content): a document as a model is to see it, pages in order."""
    if representation == "layout-native":
        have = [c for c in ("x0", "y0", "x1", "y1") if c in blocks.columns]
        one = F.struct("page_number", "reading_order", "block_id", "block_type", "text", *have)
        return blocks.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("content"))
    pages = (layout_transcript if representation == "layout-transcript" else page_text)(blocks.where(strip(F.col("text")) != ""))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "transcript"))), lambda p: p["transcript"]), "\n").alias("content"))


def requests(blocks: DataFrame, settings: Settings, schema: dict, *, instruction: str, template: str = "") -> DataFrame:
    """(doc_id, request, input_tokens): one request a document, as JSON; `blocks` have to be masked already (privacy.mask_blocks).

    The system message is the instruction; the user's is the template, the way the document is shown, and the document.
    """
    wanted = pruned_schema(schema, settings.scope)
    head = "\n\n".join(x for x in (template, f"Answer with JSON for this schema:\n{json.dumps(wanted, sort_keys=True)}", f"Document ({settings.representation}):") if x) + "\n"
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit(head), "content").alias("content")))
    body = F.to_json(F.struct(F.lit(settings.model).alias("model"), messages.alias("messages"), *(F.lit(v).alias(k) for k, v in settings.sampling.items())))
    return shown(blocks, settings.representation).select("doc_id", body.alias("request")).withColumn("input_tokens", estimate_tokens(F.col("request")))


def formats(schema: dict) -> list[dict | None]:
    """Answers to ask for, the strictest first; a provider that refuses one is asked for the next."""
    return [{"type": "json_schema", "json_schema": {"name": "extracted_profile", "strict": True, "schema": schema}}, {"type": "json_object"}, None]


class FormatUnsupported(Exception):
    """What a provider raises for a format of answers that it does not know."""


def content_of(completion: str) -> tuple[str | None, str | None]:
    """(text, finish reason) of a completion's JSON; no text where there is none."""
    try:
        choice = json.loads(completion)["choices"][0]
        text = choice["message"]["content"]
    except (ValueError, KeyError, IndexError, TypeError):
        return None, None
    return (json.dumps(text) if isinstance(text, dict) else text if isinstance(text, str) else None), choice.get("finish_reason")


def degenerate(text: str | None, reason: str | None) -> bool:
    """An answer that ran into its limit repeating nulls."""
    return bool(text and reason == "length" and repair.REPEATED_NULLS.search(text.replace('"null"', "null")))


def lost(before: dict, after: dict) -> dict[str, int]:
    """How many entries and references of a first answer its correction has fewer of, and entries that it no longer names."""
    a, b = repair.counts(before), repair.counts(after)
    out = {f"{kind}.{what}": a[kind][what] - b[kind][what] for kind in ENTITIES for what in ("entities", "evidenceReferences") if a[kind][what] > b[kind][what]}
    gone = len(repair.signatures(before) - repair.signatures(after))
    return out | ({"signatures": gone} if gone else {})


Check = Callable[[dict], list[str]]


def missing_fields(profile: dict) -> list[str]:
    """Paths of entries without what each needs: a title, an institution, a name; and of collections that are no lists."""
    out = [k for k in (*ENTITIES, "skills") if k in profile and not isinstance(profile[k], list)]
    for kind, need in (("experiences", "jobTitle"), ("projects", "title"), ("education", "institution"), ("skills", "name")):
        for i, e in enumerate(profile.get(kind) or () if isinstance(profile.get(kind), list) else ()):
            if not isinstance(e, dict) or not isinstance(e.get(need), str):
                out.append(f"{kind}.{i}.{need}")
    return out


def converse(call: Callable[[dict], str], request: str, schema: dict, check: Check = missing_fields, retries: int = 2) -> dict:
    """One document's exchange: response (repaired JSON), error, attempts, funnel (counts by attempt, no text).

    Formats fall back, calls are repeated on errors (not on Auth...), an answer that repeats itself is asked for once more, an
    invalid one is corrected once, and a correction that lost entries or references is refused.
    """
    attempts, funnel = 0, {}

    def post(body: dict) -> str:
        nonlocal attempts
        for k in range(1 + retries):
            attempts += 1
            try:
                return call(body)
            except Exception as e:
                if isinstance(e, FormatUnsupported) or type(e).__name__.startswith("Auth") or k == retries:
                    raise
        raise AssertionError

    def read(completion: str, name: str) -> tuple[dict | None, list[str], str | None]:
        text, _ = content_of(completion)
        fixed, error = repair.payload(text)
        if fixed is None:
            funnel[name] = {"validationErrors": [error]}
            return None, [error], text
        profile = json.loads(fixed)
        faults = check(profile)
        funnel[name] = {"llmRecognized": repair.counts(profile), "validationErrors": faults}
        return profile, faults, text

    def out(profile: dict | None, error: str | None) -> dict:
        return {"response": json.dumps(profile, sort_keys=True, ensure_ascii=False) if profile is not None else None, "error": error, "attempts": attempts, "funnel": json.dumps(funnel, sort_keys=True)}

    base = json.loads(request)
    try:
        for form in formats(schema):
            body = base | ({"response_format": form} if form else {})
            try:
                completion = post(body)
            except FormatUnsupported:
                continue
            if degenerate(*content_of(completion)):
                completion = post(body | NUDGE)
                if degenerate(*content_of(completion)):
                    return out(None, "LLM_DEGENERATE_RESPONSE")
            if content_of(completion)[0] is None:
                return out(None, "LLM_EMPTY_RESPONSE")
            first, faults, text = read(completion, "initial")
            if first is not None and not faults:
                return out(first, None)
            again = body | {"messages": [*body["messages"], {"role": "assistant", "content": text or ""}, {"role": "user", "content": CORRECTION.format(paths="; ".join(map(str, faults)))}]}
            second, faults, _ = read(post(again), "correction")
            if second is None or faults:
                return out(None, "LLM_MALFORMED_RESPONSE")
            funnel["semanticRegression"] = lost(first or {}, second)
            return out(None, "LLM_SEMANTIC_REGRESSION") if funnel["semanticRegression"] else out(second, None)
        return out(None, "LLM_REQUEST_FAILED")
    except Exception as e:
        return out(None, type(e).__name__)


def extract(requests_: DataFrame, make: Callable[[], Callable[[dict], str]], schema: dict, *, check: Check = missing_fields, retries: int = 2, parallel: int = 4) -> DataFrame:
    """`requests_` (doc_id, request) with response, error, attempts and funnel; at most `parallel` tasks call, a document that fails keeps its row."""
    ship(requests_.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            done = [converse(call, r, schema, check, retries) for r in b["request"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), **{k: [d[k] for d in done] for k in ("response", "error", "attempts", "funnel")}})

    kind = requests_.schema["doc_id"].dataType.simpleString()
    return requests_.select("doc_id", "request").coalesce(parallel).mapInPandas(run, f"doc_id {kind}, response string, error string, attempts int, funnel string")


#: Fields of an answer by the names that it uses. Fixed by the contract.
_ANSWER_EVIDENCE = "array<struct<text:string,pageNumber:int,blockId:string>>"
ANSWER = (
    f"candidateName string, headline string, professionalSummary string, email string, phone string, urls array<string>, languages array<string>, certifications array<string>, evidence map<string,{_ANSWER_EVIDENCE}>, "
    f"skills array<struct<name:string,evidence:{_ANSWER_EVIDENCE}>>, "
    f"experiences array<struct<jobTitle:string,company:string,location:string,startDate:string,endDate:string,isCurrent:boolean,description:array<string>,achievements:array<string>,skills:array<string>,evidence:{_ANSWER_EVIDENCE}>>, "
    f"projects array<struct<title:string,role:string,description:array<string>,skills:array<string>,achievements:array<string>,startDate:string,endDate:string,evidence:{_ANSWER_EVIDENCE}>>, "
    f"education array<struct<institution:string,degree:string,fieldOfStudy:string,location:string,startDate:string,endDate:string,coursework:array<string>,evidence:{_ANSWER_EVIDENCE}>>"
)


def url_of(c):
    """A web address with its scheme; null for what is none."""
    u = strip(c)
    return F.when(F.regexp_like(u, F.lit(r"(?i)^https?://[^\s/]+\.[^\s]+$")), u).when(F.regexp_like(u, F.lit(r"^[^\s/@:]+\.[A-Za-z]{2,}(?:/\S*)?$")), F.concat(F.lit("https://"), u))


def to_profiles(answers: DataFrame, table: DataFrame | None = None, *, column: str = "response") -> DataFrame:
    """Profiles (document.PROFILE) of repaired answers; what a model is sure of is 1 with evidence, 0 without.

    `table`, a skill table, gives skills their canonical names. Honours and language proficiencies are no part of an answer.
    """
    rows = answers.select("doc_id", F.from_json(column, ANSWER).alias("r")).where("r IS NOT NULL").select("doc_id", "r.*")
    cited = lambda e: F.transform(F.coalesce(e, F.expr("array()").cast(_ANSWER_EVIDENCE)), lambda x: F.struct(x["text"].alias("text"), x["pageNumber"].alias("page_number"), x["blockId"].alias("block_id")))
    sure = lambda e: F.when(F.size(F.coalesce(e, F.expr("array()").cast(_ANSWER_EVIDENCE))) > 0, 1.0).otherwise(0.0)
    day = lambda d: F.try_to_date(d)
    lists = {
        "experiences": F.transform("experiences", lambda e: F.struct(e["jobTitle"].alias("job_title"), e["company"].alias("company"), e["location"].alias("location"), day(e["startDate"]).alias("start_date"), day(e["endDate"]).alias("end_date"), F.coalesce(e["isCurrent"], F.lit(False)).alias("is_current"), e["description"].alias("description"), e["achievements"].alias("achievements"), e["skills"].alias("skills"), cited(e["evidence"]).alias("evidence"), sure(e["evidence"]).alias("confidence")).cast(PROFILE["experiences"][6:-1])),
        "projects": F.transform("projects", lambda e: F.struct(e["title"].alias("title"), e["role"].alias("role"), e["description"].alias("description"), e["achievements"].alias("achievements"), e["skills"].alias("skills"), day(e["startDate"]).alias("start_date"), day(e["endDate"]).alias("end_date"), cited(e["evidence"]).alias("evidence"), sure(e["evidence"]).alias("confidence")).cast(PROFILE["projects"][6:-1])),
        "education": F.transform("education", lambda e: F.struct(e["institution"].alias("institution"), e["degree"].alias("degree"), e["fieldOfStudy"].alias("field_of_study"), e["location"].alias("location"), day(e["startDate"]).alias("start_date"), day(e["endDate"]).alias("end_date"), e["coursework"].alias("coursework"), cited(e["evidence"]).alias("evidence"), sure(e["evidence"]).alias("confidence")).cast(PROFILE["education"][6:-1])),
        "skills": F.transform("skills", lambda e: F.struct(e["name"].alias("name"), e["name"].alias("canonical_name"), F.lit(None).cast("double").alias("years"), F.lit(None).cast("string").alias("level"), F.transform(F.coalesce(e["evidence"], F.expr("array()").cast(_ANSWER_EVIDENCE)), lambda x: x["text"]).alias("evidence"), F.array().cast("array<string>").alias("evidence_types"), sure(e["evidence"]).alias("confidence")).cast(PROFILE["skills"][6:-1])),
    }
    rows = rows.withColumns(lists).withColumn("urls", F.filter(F.transform("urls", url_of), lambda u: u.isNotNull()))
    field_evidence = F.transform_values("evidence", lambda k, v: cited(v))
    rows = rows.withColumn("field_evidence", field_evidence).withColumn("field_confidence", F.transform_values("evidence", lambda k, v: sure(v)))
    out = as_profiles(rows.withColumnsRenamed({"candidateName": "candidate_name", "professionalSummary": "summary"}).drop("evidence"))
    if table is None:
        return out
    named = out.select("doc_id", F.posexplode("skills").alias("n", "s")).withColumn("k", F.lower(strip("s.name"))).join(table.select(F.col("alias").alias("k"), "canonical"), "k", "left")
    again = F.struct("n", F.col("s").withField("canonical_name", F.coalesce("canonical", strip(F.col("s.name")))).alias("s"))
    named = named.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(again)), lambda x: x["s"]).alias("_s"))
    return out.join(named, "doc_id", "left").withColumn("skills", F.coalesce("_s", "skills")).drop("_s")
