"""Where each operator of the survey's inventory lives: by its ID, dotted names below ``docgrain``, or why it is absent."""

from __future__ import annotations

WHERE: dict[str, str] = {
    "C1": "config.lookup",
    "C2": "config.load_settings",
    "C3": "config.Settings",
    "C4": "config.ensure_directories",
    "C5": "config.validate",
    "S1": "sources.files.scan",
    "S2": "sources.files.parse sources.files.title_of sources.files.stem",
    "S3": "sources.files.text_of",
    "S4": "sources.files.text_of",
    "S5": "sources.files.text_of",
    "S6": "sources.files.write_jsonl",
    "S7": "sources.files.read_jsonl",
    "S8": "sources.files.read_chunks",
    "S9": "sources.segments.SegmentedIndex engine.Engine.build",
    "S10": "sources.indexes.save_lexical sources.indexes.load_lexical",
    "S11": "sources.indexes.save_dense sources.indexes.load_dense",
    "S12": "sources.files.read_items",
    "S13": "sources.files.write_report sources.files.markdown_report engine.Engine.full_report",
    "F1": "functions.text.normalize_text sources.files.compose",
    "F2": "functions.text.infer_department",
    "F3": "functions.text.infer_access_level",
    "F4": "functions.text.infer_updated_at",
    "F5": "functions.text.index_text",
    "F6": "functions.text.index_tokens",
    "F7": "functions.text.strip_accents",
    "F8": "functions.text.all_tokens",
    "F9": "functions.text.overlap_tokens",
    "F10": "functions.text.dedup_keep_order",
    "F11": "functions.text.overlap_score",
    "F12": "functions.text.phrase_score",
    "F13": "functions.text.best_phrase_score",
    "F14": "functions.text.quoted_phrases",
    "F15": "functions.text.query_targets",
    "F16": "operators.answering.features",
    "F17": "functions.text.is_yes_no",
    "F18": "functions.text.number_tokens",
    "F19": "functions.text.acronym_tokens",
    "F20": "functions.text.numbers_supported",
    "F21": "functions.text.acronyms_supported",
    "F22": "functions.text.token_coverage",
    "F23": "functions.text.snippet",
    "F24": "functions.text.draft_bullet",
    "F25": "functions.text.first_sentence",
    "F26": "functions.text.signature",
    "F27": "functions.text.search_snippet",
    "F28": "functions.text.parse_date",
    "F29": "functions.text.build_prompt",
    "F30": "functions.text.clarifying_question",
    "F31": "functions.text.domain_from_department",
    "F32": "functions.text.last_section",
    "K1": "operators.chunking.section_blocks",
    "K2": "operators.chunking.windows",
    "K3": "operators.chunking.build_chunks operators.chunking.chunk_id",
    "K4": "operators.chunking.chunks_from_rows",
    "K5": "sources.files.ingest",
    "B1": "operators.lexical.build_index",
    "B2": "operators.lexical.fallback_idf",
    "B3": "operators.lexical.candidates",
    "B4": "operators.lexical.okapi_idf operators.lexical.candidates",
    "B5": "operators.lexical.search",
    "B6": "sources.indexes.load_lexical operators.lexical.search",
    "D1": "operators.dense.Embedding",
    "D2": "operators.dense.hash_vectors operators.dense.bucket",
    "D3": "operators.dense.Embedding.encode",
    "D4": "operators.dense.build_index",
    "D5": "operators.dense.search operators.dense.nearest",
    "D6": "sources.indexes.load_dense operators.dense.search",
    "R1": "operators.fusion.minmax",
    "R2": "operators.fusion.rrf",
    "R3": "operators.fusion.fuse",
    "R4": "operators.fusion.query_weights",
    "R5": "operators.fusion.recency_boost",
    "R6": "operators.fusion.metadata_boost",
    "R7": "operators.fusion.threshold_filter",
    "R8": "plans.retrieval.retrieve",
    "R9": "plans.retrieval.search plans.retrieval.search_debug",
    "A1": "operators.generation.effective operators.generation.local_model",
    "A2": "operators.generation.draft_answer",
    "A3": "operators.generation.drafted operators.generation.read_output",
    "A4": "operators.generation.drafted",
    "A5": "operators.answering.select_citations",
    "A6": "operators.answering.confidence",
    "A7": "operators.answering.gates",
    "A8": "operators.answering.features operators.answering.gated operators.answering.answers",
    "A9": "plans.retrieval.ask plans.retrieval.ask_debug",
    "E1": "operators.evaluation.recall_at_k",
    "E2": "operators.evaluation.reciprocal_rank",
    "E3": "operators.evaluation.retrieval_summary",
    "E4": "operators.evaluation.ranked_ids",
    "E5": "operators.evaluation.run_retrieval_eval",
    "E6": "operators.evaluation.answer_summary",
    "E7": "engine.Engine.evaluate",
    "E8": "engine.Engine.report operators.evaluation.failures operators.evaluation.failure_counts operators.evaluation.failure_samples operators.evaluation.failure_rates",
    "E9": "operators.datasets.easy_question operators.datasets.hard_question",
    "E10": "operators.datasets.multi_hop_items",
    "E11": "functions.fixed.NEGATIVE_QUESTIONS operators.datasets.negative_items",
    "E12": "operators.datasets.generate",
    "E13": "operators.datasets.with_numbers",
    "E14": "operators.datasets.stratified_split",
    "E15": "operators.datasets.summarize",
    "U1": "engine.Engine.health",
    "U2": "engine.Engine.search",
    "U3": "engine.Engine.ask",
    "U4": "plans.retrieval.retrieve",
    "U5": "engine.service",
    "U7": "__main__.main engine.Engine.ingest engine.Engine.evaluate",
    "U8": "engine.Engine",
    "U9": "sources.files.split_items engine.Engine.full_report __main__.arguments",
}

ABSENT: dict[str, str] = {
    "E16": "the scripted checks: the tests stand for them",
    "U6": "a web form and a server process: presentation",
}
