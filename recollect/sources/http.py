"""JSON over HTTP with retries. Used inside tasks by the remote providers."""

from __future__ import annotations

import email.utils
import json
import random
import time
import urllib.error
import urllib.request

MAX_WAIT = 300.0


def parse_retry_after(value: str | None, now: float | None = None) -> float:
    """Seconds to wait: a number or an HTTP date, 0 when it says neither."""
    value = (value or "").strip()
    if value.isdigit():
        return float(value)
    try:
        at = email.utils.parsedate_to_datetime(value).timestamp()
    except (TypeError, ValueError):
        return 0.0
    return max(0.0, at - (time.time() if now is None else now))


def next_delay(delay: float, cap: float = 60.0, jitter=random.random) -> float:
    """Twice the delay up to the cap, a quarter more or less."""
    return min(2 * delay, cap) * (0.75 + 0.5 * jitter())


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, retries: int = 3,
              timeout: float = 60.0, base: float = 2.0, send=None, sleep=time.sleep) -> dict:
    """Retries on transport errors, 429 and 5xx. `send(url, data, headers, timeout)` gives
    (status, headers, text) and can be replaced in tests."""
    send = send or _send
    data = json.dumps(body).encode()
    delay, failure = base, "no attempt made"
    for attempt in range(retries + 1):
        if attempt:
            sleep(delay)
            delay = next_delay(delay)
        try:
            status, got, text = send(url, data, {"Content-Type": "application/json", **(headers or {})}, timeout)
        except OSError as error:
            failure = str(error)
            continue
        if 200 <= status < 300:
            return json.loads(text)
        failure = f"HTTP {status}: {text[:500]}"
        if status != 429 and status < 500:
            raise RuntimeError(failure)
        wait = min(parse_retry_after(got.get("Retry-After")), MAX_WAIT)
        if wait:
            sleep(wait)
            delay = base
    raise RuntimeError(f"after {retries + 1} attempts: {failure}")


def _send(url: str, data: bytes, headers: dict[str, str], timeout: float):
    request = urllib.request.Request(url, data=data, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, dict(reply.headers), reply.read().decode()
    except urllib.error.HTTPError as error:
        return error.code, dict(error.headers), error.read().decode(errors="replace")
