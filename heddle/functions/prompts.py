"""Prompt columns for training, evaluation and judging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import capitalized, filled, stripped

#: Instructions and turn formats of the two model families.
LLAMA_SYSTEM = """You are an expert in composing functions. You are given a question and a set of possible functions.
Based on the question, you will need to make one or more function/tool calls to achieve the purpose.
If none of the functions can be used, point it out.
If the given question lacks the parameters required by the function, also point it out.
You should only return the function call in tool call sections.
If you decide to invoke any of the function(s), you MUST put it in the format of
[func_name1(param1=value1, param2=value2...), func_name2(...)]
You SHOULD NOT include any other text in the response if you call a function.
"""
LLAMA_TOOLS = "Here is a list of functions in JSON format that you can invoke.\n"
GEMMA_USER = """You have access to functions.

Decide how to respond to the question using the provided functions.
- If a provided function directly answers the question and the required arguments are available, return a tool call.
- If the correct function exists but a required argument is missing, ask for that missing information.
- If no provided function can answer the question, say that you cannot answer with the provided tools.

If you decide to invoke a function, you MUST put it in the format:
{"name": "tool_name", "arguments": {"argument1": "value1", "argument2": "value2"}}

You SHOULD NOT include any other text in the response if you call a function.
"""


def _turn(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n"), content, F.lit("\n<|eot_id|>\n"))


def training_prompt(family: str, tools: Column, context: Column) -> Column:
    """The prompt for the turns of `context`, the first of which has to be a user's; an error where it isn't."""
    first, rest = F.get(context, F.lit(0)), F.slice(context, 2, F.greatest(F.size(context), F.lit(1)))
    if family == "llama":
        opening = F.concat(F.lit("<|begin_of_text|>"), _turn("system", F.lit(LLAMA_SYSTEM.rstrip())), _turn("user", F.concat(F.lit(LLAMA_TOOLS), tools, F.lit("\n\n"), stripped(first["content"]))))
        turns = F.array_join(F.transform(rest, lambda m: _turn(m["role"], stripped(m["content"]))), "")
        prompt = F.concat(opening, turns, F.lit("<|start_header_id|>assistant<|end_header_id|>\n"))
    elif family == "gemma":
        opening = F.concat(F.lit("<start_of_turn>user\n" + GEMMA_USER + "\nFunctions:\n"), tools, F.lit("\nQuestion:\n"), stripped(first["content"]), F.lit("\n"))
        turns = F.array_join(F.transform(rest, lambda m: F.concat(capitalized(m["role"]), F.lit(":\n"), stripped(m["content"]), F.lit("\n"))), "")
        prompt = F.concat(opening, turns, F.lit("<end_of_turn>\n<start_of_turn>model\n"))
    else:
        raise ValueError(f"no prompt for family {family!r}")
    return F.when(first["role"] == "user", prompt).otherwise(F.raise_error(F.lit("the first context message has to be a user's")))


def policy_prompt(family: str, tools: Column, messages: Column) -> Column:
    """The prompt that a policy answers: as for training, with a last answer of the assistant's left out."""
    from ..operators.records import without_answer

    return training_prompt(family, tools, without_answer(messages))


def eval_prompt(family: str, question: Column, tools: Column, shots: tuple[dict, ...] = ()) -> Column:
    """The prompt for a question after worked examples (question, tools, answer): a tagged call as an answer is written as
    the family writes it, all else stripped."""
    from .toolcall import shot_answer

    shots = tuple({**s, "answer": shot_answer(s["answer"], family)} for s in shots)
    if family == "llama":
        head = f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{LLAMA_SYSTEM}<|eot_id|>\n"
        user, answer = f"<|start_header_id|>user<|end_header_id|>\n{LLAMA_TOOLS}", "\n<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
        for s in shots:
            head += f"{user}{s['tools']}\n\n{s['question'].strip()}{answer}{s['answer']}\n<|eot_id|>\n"
        return F.concat(F.lit(head + user), tools, F.lit("\n\n"), stripped(question), F.lit(answer))
    if family == "gemma":
        head = "<start_of_turn>user\n" + GEMMA_USER
        for k, s in enumerate(shots, 1):
            head += f"\nExample {k}\nFunctions:\n{s['tools']}\nQuestion:\n{s['question'].strip()}\nAnswer:\n{s['answer']}\n"
        return F.concat(F.lit(head + "\nFunctions:\n"), tools, F.lit("\nQuestion:\n"), stripped(question), F.lit("<end_of_turn>\n<start_of_turn>model\n"))
    raise ValueError(f"no prompt for family {family!r}")


def chat(family: str, text: Column) -> Column:
    """A single user turn as a family's chat format has it; some families take the text as it is."""
    wraps = {
        "llama": ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n", "\n<|eot_id|>\n<|start_header_id|>assistant<|end_header_id|>\n"),
        "gemma": ("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n"),
        "qwen": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
        **{raw: ("", "") for raw in ("gpt-oss", "phi", "mistral")},
    }
    if family not in wraps:
        raise ValueError(f"no chat format for family {family!r}")
    before, after = wraps[family]
    return F.concat(F.lit(before), text, F.lit(after))


def judged_prompt(family: str, template: Column | str, constitution: Column, request: Column, tools: Column, **answers: Column) -> Column:
    """A judge's template filled in: CONSTITUTION, USER_REQUEST and TOOLS, and then the answers by their names, stripped."""
    values = {"CONSTITUTION": constitution, "USER_REQUEST": request, "TOOLS": tools} | {k: stripped(v) for k, v in answers.items()}
    return chat(family, filled(template, **values))


def critique_prompt(family: str, template: Column | str, constitution: Column, request: Column, tools: Column, response: Column) -> Column:
    return judged_prompt(family, template, constitution, request, tools, ASSISTANT_RESPONSE=response)


def revision_prompt(family: str, template: Column | str, constitution: Column, request: Column, tools: Column, response: Column, critique: Column) -> Column:
    return judged_prompt(family, template, constitution, request, tools, ASSISTANT_RESPONSE=response, CRITIQUE=critique)


def preference_prompt(family: str, template: Column | str, constitution: Column, request: Column, tools: Column, a: Column, b: Column) -> Column:
    return judged_prompt(family, template, constitution, request, tools, RESPONSE_A=a, RESPONSE_B=b)


def preference_example(family: str, tools: Column, messages: Column, chosen: Column, rejected: Column) -> Column:
    """struct(prompt, chosen, rejected): the messages as context, and both answers as the family writes them."""
    from .toolcall import rendered

    return F.struct(training_prompt(family, tools, messages).alias("prompt"), rendered(chosen, family).alias("chosen"), rendered(rejected, family).alias("rejected"))
