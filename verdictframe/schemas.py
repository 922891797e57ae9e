"""Table schemas (Spark DDL) and closed value sets."""

from __future__ import annotations

PASSAGE = (
    "struct<passage_id:int,text:string,provider:string,passage_date:string,"
    "evidence_relevant:string,evidence_correct:string,evidence_cited:string,was_modified:boolean>"
)
MODIFICATION = (
    "struct<passage_id:int,was_modified:boolean,modified_text:string,original_span:string,"
    "perturbed_span:string,mention_kind:string,skip_reason:string>"
)
LABEL_EVAL = (
    "struct<evaluator_provider:string,evaluator_model:string,behavior_label:string,"
    "entails_original_claim:boolean,entails_perturbed_claim:boolean,rationale:string,"
    "confidence:string,run_id:string,completed_at:bigint>"
)
ANSWER = (
    "struct<generator_provider:string,generator_model:string,mode:string,sample_id:int,"
    "answer_text:string,cited_passage_ids:array<int>,is_refusal:boolean,"
    "entails_original_claim:boolean,entails_perturbed_claim:boolean,behavior_label:string,"
    f"notes:string,llm_eval:{LABEL_EVAL},run_id:string,completed_at:bigint>"
)
VERDICT = (
    "struct<judge_provider:string,judge_model:string,generator_provider:string,"
    "generator_model:string,generator_mode:string,generator_sample_id:int,pair_type:string,"
    "verdict:string,contains_factual_error:boolean,wrong_claim:string,"
    "supporting_source_passage_id:int,explanation:string,confidence:string,"
    "gold_has_induced_error:boolean,gold_perturbation_target:string,"
    "gold_perturbation_replacement:string,run_id:string,completed_at:bigint>"
)
VALIDATION = (
    "struct<type_valid:boolean,answer_causal:boolean,global_context_consistent:boolean,"
    "no_original_answer_leakage:boolean,original_contradicts_perturbed:boolean,"
    "plausibility:string,human_audited:boolean,rejection_reasons:array<string>>"
)
PROVENANCE = "struct<provider:string,model:string,run_id:string,completed_at:bigint>"

CORE = (
    "core_id string, garage_sample_id string, question string, question_date string, "
    "question_category string, question_complexity string, question_popularity string, "
    "question_type string, answer_generate string, "
    f"all_grounding_original array<{PASSAGE}>, answer_containing_passage_ids array<int>, "
    "atomic_claim_original string, atomic_claim_perturbed string, original_value string, "
    "perturbed_value string, perturbation_type string, perturbation_subtype string, "
    "plausibility string, deducibility_note string, sent_passage_ids array<int>, "
    f"doc_modifications array<{MODIFICATION}>, backstop_modified_passage_ids array<int>, "
    f"modified_passage_ids array<int>, all_grounding_perturbed array<{PASSAGE}>, "
    f"validation {VALIDATION}, pipeline_state map<string,string>, "
    f"generators map<string,{PROVENANCE}>, "
    f"generator_outputs array<{ANSWER}>, judge_verdicts array<{VERDICT}>"
)

TRACES = (
    "event_id string, run_id string, step string, core_id string, model string, provider string, "
    "started_at double, ended_at double, latency_ms bigint, system_prompt string, "
    "user_prompt string, raw_response string, parsed_output string, input_tokens bigint, "
    "output_tokens bigint, error string, metadata map<string,string>"
)

REVIEW_LABELS = (
    "case_id string, human_gold_ok string, human_judge_ok string, human_notes string, updated_at bigint"
)

# The closed sets of the record format.
GATES = (
    "type_valid",
    "answer_causal",
    "global_context_consistent",
    "no_original_answer_leakage",
    "original_contradicts_perturbed",
)
STEP_ORDER = ("filter", "perturb", "validate", "generate", "label_eval", "judge")
BEHAVIOR_LABELS = (
    "context_follow",
    "memory_override",
    "both_claims",
    "conflict_awareness",
    "refusal_or_insufficient",
    "unrelated_or_failed",
)
GENERATION_MODES = ("rag_perturbed", "rag_original", "closed_book")
PAIR_TYPES = ("same_exact_model", "same_provider_family", "cross_provider_family")
VERDICTS = ("correct", "incorrect", "unclear")
LEVELS = ("high", "medium", "low")
CELLS = ("TP", "FP", "FN", "TN")
PROVIDER_FAMILY = {
    "azure-gpt": "openai_family",
    "grok": "xai_family",
    "gemini": "google_family",
    "kimi": "moonshot_family",
}
UNKNOWN_FAMILY = "unknown_family"
MENTION_KINDS = ("explicit", "paraphrased", "entailed")
CHANGE_TYPES = (
    "entity_substitution",
    "temporal_shift",
    "numerical_shift",
    "relation_inversion",
    "location_change",
    "affiliation_change",
    "ranking_flip",
    "causal_change",
    "negation_modality",
    "multihop_bridge",
)
