"""Schemas of the raw sources and of the tables made from them."""

from __future__ import annotations

#: Nested dialogues: articles of paragraphs of questions.
DIALOGUES = (
    "data array<struct<paragraphs:array<struct<id:string,context:string,qas:array<struct<"
    "question:string,followup:string,yesno:string,answers:array<struct<text:string>>>>>>>>"
)
#: Rule-based conditional questions.
_FOLLOW = "array<struct<follow_up_question:string,follow_up_answer:string>>"
CONDITIONAL = (
    "utterance_id string, tree_id string, source_url string, snippet string, question string, scenario string, answer string, "
    f"history {_FOLLOW}, evidence {_FOLLOW}"
)
#: Multi-hop questions over titled paragraphs.
MULTI_HOP = (
    "question string, answer string, type string, level string, supporting_facts struct<title:array<string>,sent_id:array<int>>, "
    "context struct<title:array<string>,sentences:array<array<string>>>"
)
#: Contracts with annotated hypotheses.
CONTRACTS = (
    "labels map<string,struct<hypothesis:string,short_description:string>>, "
    "documents array<struct<id:string,file_name:string,text:string,spans:array<array<int>>,"
    "annotation_sets:array<struct<annotations:map<string,struct<choice:string,spans:array<int>>>>>>>"
)
CONTEXT = "struct<documents:array<struct<doc_id:string,text:string,url:string,file_name:string,spans:array<string>>>>"
STATE = "struct<known_variables:array<string>,missing_variables:array<string>,constraints:array<string>,failure_mode:string,difficulty:string,completeness:string>"
METADATA = (
    "struct<num_missing_variables:int,variable_types:array<string>,multi_turn:boolean,turn_id:int,dialogue_id:string,requires_reasoning:boolean,"
    "source:string,yesno:string,followup_flag:string,utterance_id:string,sharc_answer:string,evidence_depth:int,history_depth:int,"
    "question_type:string,level:string,num_supporting_facts:int,label_id:string,nli_choice:string,num_spans:int>"
)
SAMPLE = f"id string, query string, context {CONTEXT}, state {STATE}, action string, response string, metadata {METADATA}"
