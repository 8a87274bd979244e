"""Model providers: batches of requests in, raw answers out, with key rotation and back-off per partition."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ERROR_WORDS
from ..operators.graphs import saved


def error_kind(message: str) -> str:
    text = message.lower()
    return next((kind for kind, words in ERROR_WORDS if any(w in text for w in words)), "unknown_error")


class ProviderError(RuntimeError):
    def __init__(self, message: str, kind: str):
        super().__init__(message)
        self.kind = kind


class KeyRing:
    """Which key to use next. Quota and key errors retire a key, rate limits wait on it ever longer, others stop the run."""

    def __init__(self, keys: list[str], sleep: Callable[[float], None]):
        if not keys:
            raise ValueError("no keys")
        self.keys, self.sleep = list(keys), sleep
        self.at, self.retired, self.waits = 0, set(), {}

    @property
    def key(self) -> str:
        return self.keys[self.at]

    def failed(self, message: str) -> None:
        kind = error_kind(message)
        if kind in ("quota_exhausted", "auth_error"):
            self.retired.add(self.at)
            left = [i % len(self.keys) for i in range(self.at + 1, self.at + 1 + len(self.keys)) if i % len(self.keys) not in self.retired]
            if not left:
                raise ProviderError(f"all {len(self.keys)} keys are used up", "quota_exhausted")
            self.at = left[0]
        elif kind == "rate_limited":
            wait = self.waits.get(self.at, 5)
            self.waits[self.at] = min(120, wait * 2)
            self.sleep(wait)
        elif kind == "network_timeout":
            self.sleep(5)
        else:
            raise ProviderError(message[:300], kind)


def by_section(one: Callable[[str, str], str]) -> Callable[[str, str], str]:
    """A provider for requests of several functions from one for a single function: an object of answers under the functions' names.

    A function's part begins with the line `--- NAME ---`; what stands before the first such line goes to all of them.
    """

    def many(prompt: str, key: str) -> str:
        parts = re.split(r"(?m)^--- (.+) ---$", prompt)
        if len(parts) == 1:
            return one(prompt, key)
        return json.dumps({name: json.loads(one(f"--- {name} ---{body}", key)) for name, body in zip(parts[1::2], parts[2::2])})

    return many


def _named_by_calls(prompt: str, key: str) -> str:
    calls = next((line.split(": ", 1)[1].split(", ")[0] for line in prompt.split("\n") if line.startswith(("// APIs: ", "// Calls: "))), "")
    name = f"call_{calls}" if calls else prompt.split("\n", 1)[0].strip("- ")
    return json.dumps({"name": name, "confidence": 0.7 if calls else 0.3, "category": "UTIL", "evidence": [f"calls {calls}"] if calls else []})


def offline(prompt: str, key: str) -> str:
    """A deterministic stand-in for a model. It names a function after the first call or API its prompt lists; several functions get an
    answer each, by name. Structures, prototypes and variables get plain names from what the prompt lists."""
    task, field = re.match(r"Task: (\w+)", prompt), lambda title: next((line.split(": ", 1)[1] for line in prompt.split("\n") if line.startswith(f"{title}: ")), "")
    if task and task[1] == "structure":
        return json.dumps({"struct_name": f"{field('Function')}_data", "confidence": 0.7, "fields": [{"offset": int(o, 16), "name": f"field_{o}", "type": "QWORD"} for o in re.findall(r"0x([0-9a-f]+) ", field("Offsets") + " ")]})
    if task and task[1] == "prototype":
        return json.dumps({"prototype": f"int {field('Function')}(void)", "confidence": 0.6, "reason": "no arguments seen"})
    if task and task[1] == "range":
        return json.dumps({"summary": f"{prompt.count(chr(10)) - 3} lines of code", "evidence": re.findall(r"\b[A-Z][a-z]+[A-Z]\w+", prompt.split("```", 1)[1].rsplit("```", 1)[0])[:8], "warnings": []})
    if task and task[1] == "program":
        return json.dumps({"summary": next((line for line in prompt.split("\n") if line.startswith("Binary: ")), ""), "capabilities": [line.split(": ")[0].lower() for line in prompt.split("\n") if re.match(r"[A-Z0-9_]+: ", line)], "evidence": [], "risk": "unknown"})
    if task and task[1] == "variables":
        return json.dumps({"variables": [{"old_name": name, "new_name": f"{kind}_{i}", "confidence": 0.6, "reason": f"a {kind}"} for i, (name, kind) in enumerate(re.findall(r"(?m)^- (\S+) : (\w+)", prompt))]})
    if len(re.findall(r"(?m)^--- .+ ---$", prompt)) > 1:
        return by_section(_named_by_calls)(prompt, key)
    return _named_by_calls(prompt[max(0, prompt.find("--- ")) :], key)


#: Public addresses that the named services answer at; local ones for programs on the same machine.
BASE_URLS = {"gemini": "https://generativelanguage.googleapis.com/v1beta", "groq": "https://api.groq.com/openai/v1", "openai": "https://api.openai.com/v1", "ollama": "http://127.0.0.1:11434", "lmstudio": "http://127.0.0.1:1234/v1"}
KEYLESS = ("ollama", "lmstudio")


def http_request(kind: str, model: str, prompt: str, key: str, base_url: str = "", temperature: float = 0.1, max_tokens: int = 900, chat: bool = True) -> tuple[str, dict, dict]:
    """(url, headers, body) of one request to a service: gemini, ollama without its chat form, or any that speaks the chat-completions form."""
    base = (base_url or BASE_URLS.get(kind, "")).rstrip("/")
    if not base:
        raise ProviderError(f"{kind} needs a base_url", "unknown_error")
    if kind == "gemini":
        return f"{base}/models/{model}:generateContent", {"x-goog-api-key": key}, {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": temperature, "maxOutputTokens": max_tokens}}
    messages = [{"role": "user", "content": prompt}]
    if kind == "ollama" and not chat:
        return f"{base}/api/chat", {}, {"model": model, "messages": messages, "stream": False, "options": {"temperature": temperature}}
    if kind == "ollama":
        base += "/v1"
    return f"{base}/chat/completions", {} if kind in KEYLESS else {"Authorization": f"Bearer {key}"}, {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}


def answer_text(kind: str, reply: dict) -> str:
    """The text in a service's reply; empty where it has none."""
    if kind == "gemini":
        return "".join(p.get("text", "") for c in reply.get("candidates", [])[:1] for p in c.get("content", {}).get("parts", []))
    if "message" in reply:
        return reply["message"].get("content") or ""
    return next((c.get("message", {}).get("content") or "" for c in reply.get("choices", [])), "")


def post(url: str, headers: dict, body: dict, timeout: float) -> dict:
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


def service(kind: str, model: str, base_url: str = "", temperature: float = 0.1, timeout: float = 60, send: Callable = post) -> Callable[[str, str], str]:
    """A provider over HTTP. ollama is asked in the chat-completions form first and in its own form if that fails."""

    def call(prompt: str, key: str) -> str:
        try:
            return answer_text(kind, send(*http_request(kind, model, prompt, key, base_url, temperature), timeout))
        except Exception:
            if kind != "ollama":
                raise
            return answer_text(kind, send(*http_request(kind, model, prompt, key, base_url, temperature, chat=False), timeout))

    return call


def make_provider(settings, send: Callable = post) -> Callable[[str, str], str]:
    """The provider that settings (provider, model, base_url, api_keys) name; services that need a key are refused without one."""
    kind = settings.provider.strip().lower()
    if kind == "offline":
        return offline
    if kind not in (*BASE_URLS, "openai_compatible"):
        raise ProviderError(f"no provider is called {kind}", "unknown_error")
    if kind not in KEYLESS and not any(k.strip() for k in settings.api_keys):
        raise ProviderError(f"{kind} needs an API key", "auth_error")
    return service(kind, settings.model, settings.base_url, timeout=settings.timeout_sec, send=send)


def ask(requests: DataFrame, provider: Callable[[str, str], str] = offline, keys: tuple[str, ...] = ("offline",), tries: int = 4, workers: int = 0) -> DataFrame:
    """(id, raw, error) for requests (id, prompt) from `workers` tasks, which begin with the keys in turn; 0: as many as the requests fill.

    With `workers` no more requests than that are on their way at once, and a task's share grows with the input; without, more requests make
    more tasks, each of about the session's advisory partition size, the session's cores are the limit, and a key may be in use by several
    tasks. A failed request has a null raw and the kind of its error; it does not stop the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        from pyspark import TaskContext

        first = TaskContext.get().partitionId() % len(keys) if keys else 0
        ring = None
        for batch in batches:
            raws, errors = [], []
            for prompt in batch.column(1).to_pylist():
                ring = ring or KeyRing([*keys[first:], *keys[:first]], time.sleep)
                raw, error = None, None
                for _ in range(tries):
                    try:
                        raw, error = provider(prompt, ring.key), None
                        break
                    except ProviderError as e:
                        error = e.kind
                        break
                    except Exception as e:
                        error = error_kind(str(e))
                        try:
                            ring.failed(str(e))
                        except ProviderError as stop:
                            error = stop.kind
                            break
                raws.append(raw)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.string()), pa.array(errors, pa.string())], ["id", "raw", "error"])

    spread = requests.select(F.col("id").cast("long").alias("id"), "prompt")
    spread = spread.repartition(workers, "id", "prompt") if workers else spread.hint("rebalance", "id", "prompt")
    return spread.mapInArrow(run, "id long, raw string, error string")


class SharedKeys:
    """What a task knows of all keys: those that are used up, and how long the others rest. `news` is what other tasks must hear of it."""

    def __init__(self, keys: tuple[str, ...], first: int, clock: Callable[[], float]):
        if not keys:
            raise ValueError("no keys")
        self.keys, self.clock = keys, clock
        self.order = [(first + i) % len(keys) for i in range(len(keys))]
        self.retired, self.free_at, self.waits = set(), {}, {}
        self.news: list[tuple[int, float | None]] = []

    def pick(self) -> int | None:
        """The next key that is neither used up nor at rest, the task's own first."""
        now = self.clock()
        return next((k for k in self.order if k not in self.retired and self.free_at.get(k, now) <= now), None)

    def rest(self) -> float | None:
        """Seconds until some key may be used; None if all are used up."""
        left = [self.free_at.get(k, 0.0) - self.clock() for k in self.order if k not in self.retired]
        return max(0.0, min(left)) if left else None

    def hear(self, news: list) -> None:
        """News are (key, None) for a key that is used up and (key, seconds) for one that rests; clocks of machines are never compared."""
        for key, seconds in news:
            if seconds is None:
                self.retired.add(key)
            else:
                self.free_at[key] = max(self.free_at.get(key, 0.0), self.clock() + seconds)
                self.waits[key] = max(self.waits.get(key, 5), min(120, seconds * 2))

    def failed(self, key: int, message: str) -> str:
        """Takes note of a failure; returns its kind."""
        kind = error_kind(message)
        if kind in ("quota_exhausted", "auth_error"):
            news = [(key, None)]
        elif kind == "rate_limited":
            news = [(key, self.waits.get(key, 5))]
        else:
            news = []
        self.hear(news)
        self.news += news
        return kind

    def told(self) -> list:
        news, self.news = self.news, []
        return news


def ask_together(requests: DataFrame, provider: Callable[[str, str], str] = offline, keys: tuple[str, ...] = ("offline",), tries: int = 4, workers: int = 0, period: float = 1.0) -> DataFrame:
    """As ask, from tasks that run at the same time and tell each other which keys are used up and which rest; computed once, as a checkpoint.

    The tasks are one barrier stage and meet every `period` seconds (0: before each request), so a key that one of them finds dead is not
    tried again after the next meeting, and a key's limit holds for all. A task whose key rests goes on with another. There are as many
    tasks as keys, at most as many as the session runs side by side. When an executor is lost the stage begins again, so requests
    of the lost attempt are sent twice. Requests left when every key is used up have the error quota_exhausted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        me, met = context.partitionId(), time.monotonic()
        ring = SharedKeys(keys, me % len(keys), time.monotonic)

        def meet(done: bool) -> bool:
            """Exchanges news; True when every task is done, for all of them in the same meeting."""
            nonlocal met
            all_told = [json.loads(t) for t in context.allGather(json.dumps([done, ring.told()]))]
            for task, (_, news) in enumerate(all_told):
                if task != me:
                    ring.hear(news)
            met = time.monotonic()
            return all(d for d, _ in all_told)

        def answer(prompt: str) -> tuple[str | None, str | None]:
            error, left = None, tries
            while left:
                if time.monotonic() - met >= period:
                    meet(False)
                key = ring.pick()
                if key is None:
                    rest = ring.rest()
                    if rest is None:
                        return None, "quota_exhausted"
                    time.sleep(min(rest, max(period, 0.05)))
                    continue
                left -= 1
                try:
                    return provider(prompt, keys[key]), None
                except ProviderError as e:
                    return None, e.kind
                except Exception as e:
                    error = ring.failed(key, str(e))
                    if error in ("quota_exhausted", "auth_error"):
                        left += 1  # a dead key is no try of the request; there are only so many keys
                    elif error == "network_timeout":
                        time.sleep(min(5, period * 5))
                    elif error != "rate_limited":
                        return None, error
            return None, error

        for batch in batches:
            got = [answer(prompt) for prompt in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["id", "raw", "error"])
        while not meet(True):
            pass

    tasks = min(workers or len(keys), requests.sparkSession.sparkContext.defaultParallelism)
    spread = requests.select(F.col("id").cast("long").alias("id"), "prompt").repartition(tasks)
    return saved(spread.mapInArrow(run, "id long, raw string, error string", barrier=True))
