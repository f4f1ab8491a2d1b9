"""Types of the knowledge model as Spark schemas, and its closed vocabularies."""

from __future__ import annotations

REF = "struct<kind:string,id:string>"
PAIRS = "array<struct<k:string,v:string>>"
INSTANT = "struct<s:bigint,n:int>"
#: tag: instant, interval, approximate, open-ended or unknown; kinds: inclusive, exclusive, open or unknown.
VALIDITY = f"struct<tag:string,start_kind:string,start:{INSTANT},end_kind:string,end:{INSTANT}>"
STEP = f"struct<assertion_id:string,direction:string,predicate:string,from:{REF},to:{REF}>"
PATH = f"array<{STEP}>"
AUTHORITY = "array<struct<dimension:string,value:string>>"

#: Columns of the assertion table, in order.
ASSERTION = {
    "assertion_id": "string",
    "subject": REF,
    "predicate": "string",
    "object": REF,
    "context": PAIRS,
    "qualifiers": PAIRS,
    "status": "string",
    "polarity": "string",
    "validity": VALIDITY,
    "authority": AUTHORITY,
    "source_ids": "array<string>",
    "evidence_ids": "array<string>",
    "semantic_types": "array<string>",
    "publication": "string",
    "authenticity": "string",
    "inference": "string",
}

#: The row every query operator works on.
CANDIDATE = {
    "reference": REF,
    "match_type": "string",
    "path": PATH,
    "subject": REF,
    "object": REF,
    "predicate": "string",
    "source_ids": "array<string>",
    "evidence_ids": "array<string>",
    "authority": AUTHORITY,
    "semantic_types": "array<string>",
    "status": "string",
    "publication": "string",
    "authenticity": "string",
    "validity": VALIDITY,
    "context": PAIRS,
    "inference": "string",
}

# The closed vocabularies of the model.
OBJECT_KINDS = ("entity", "concept", "source", "reference", "lexical-form", "mention")
STATUSES = ("provisional", "accepted", "disputed", "rejected", "known", "unknown", "uncertain", "ambiguous", "conflicting")
EPISTEMIC_STATUSES = ("known", "unknown", "uncertain", "ambiguous", "disputed", "conflicting")
POLARITIES = ("positive", "negative")
MATCH_TYPES = ("lookup", "traversal", "exact", "lexical", "conceptual", "relational", "semantic")
PUBLICATION_OUTCOMES = ("published", "blocked", "rejected", "withdrawn")
CHARACTERISTICS = ("symmetric", "asymmetric", "transitive", "reflexive", "functional")


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
