"""Explicit schemas: nothing is inferred, so no file is read twice."""

CONVERSATION = "id string, conversations array<struct<from:string,value:string>>"
INSTRUCTION = "instruction string, input string, output string"
MESSAGES = "messages array<struct<role:string,content:string>>"
PROMPT = "id string, prompt string, instruction string, question string"
QUESTION = "question_id bigint, category string, turns array<string>, reference array<string>"
ANSWER = (
    "question_id bigint, answer_id string, model_id string, choices array<struct<index:int,"
    "turns:array<string>,idxs:array<int>,new_tokens:array<int>,wall_time:array<double>,"
    "alpha:array<double>,alpha_num:array<double>>>, tstamp double"
)
FEATURE = "hidden_state array<array<float>>, input_ids array<int>, loss_mask array<int>"
JUDGE_TEMPLATE = (
    "name string, type string, system_prompt string, prompt_template string, "
    "description string, category string, output_format string"
)
METRIC_LOG = (
    "run string, epoch bigint, split string, worker bigint, batch bigint, position string, "
    "acc double, loss double"
)
