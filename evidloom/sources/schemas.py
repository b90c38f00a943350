"""Schemas of the files that the pipeline reads and writes."""

CLAIMS = "final_id BIGINT, source BIGINT, claim STRING, evidence STRING, judgement STRING, reasoning STRING, Entity_in_Claim STRING, Co_referenced_in_Evidence STRING, Co_referenced_in_Text STRING, type STRING"
CLAIM_FIELDS = [c.split()[0] for c in CLAIMS.split(", ")]
VERIFICATION = "source BIGINT, found BOOLEAN, title STRING, url STRING, extract_chars INT, error STRING, resolution_method STRING, resolved_pageid BIGINT, resolution_notes STRING"
RESOLVED = "source BIGINT, resolved BOOLEAN, resolution_method STRING, title STRING, url STRING, resolved_pageid BIGINT, wayback_found BOOLEAN, wayback_url STRING, snapshot_timestamp STRING, notes STRING"
CHUNKS = "array<struct<chunk_id:string,sentence_start:int,sentence_end:int,window_size:int,text:string>>"
CORPUS = f"source BIGINT, title STRING, url STRING, num_sentences INT, chunks {CHUNKS}"
DUMP = "id STRING, title STRING, url STRING, text STRING"
COLLECTION = "id STRING, contents STRING"
GOLD = "final_id BIGINT, source BIGINT, chunk_id STRING, match_type STRING, similarity DOUBLE"
LOCALIZATION = "final_id BIGINT, claim STRING, evidence STRING, source BIGINT, judgement STRING, type STRING, gold_chunk_id STRING, gold_match_type STRING, similarity DOUBLE"
