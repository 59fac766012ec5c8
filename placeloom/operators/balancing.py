"""Accounts of model clients: availability under a sliding limit, usage, error trips, choice of the best client, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Default requests a window, the window in seconds, errors after which a client is switched off, part of a quota that warns.
RATE_LIMIT, WINDOW_S, MOST_ERRORS, QUOTA_WARNING = 5, 60, 3, 0.8

RESPONSE = "struct<choices:array<struct<message:struct<role:string,content:string>>>,usage:struct<total_tokens:bigint>,data:array<struct<embedding:array<double>>>>"


def rate_limited(events: DataFrame, limit: int = RATE_LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """events (client, ts, event_id) with available: whether a request at ts may start, all earlier ones being on record: the
    limit-th last of them is at least window_s old, or there are fewer."""
    w = W.partitionBy("client").orderBy("ts", "event_id")
    oldest = F.lag("ts", limit).over(w)
    return events.withColumn("available", oldest.isNull() | ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(oldest.cast("timestamp"))) >= window_s * 1_000_000))


def usage(events: DataFrame, quota: int | None = None) -> DataFrame:
    """Running requests and tokens of each client (client, ts, event_id, tokens), and whether they are over the warning part of a quota."""
    w = W.partitionBy("client").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    out = events.withColumns({"requests": F.count("*").over(w), "total_tokens": F.sum("tokens").over(w)})
    return out.withColumn("near_quota", F.col("total_tokens") > QUOTA_WARNING * quota) if quota else out


def error_trips(events: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """client, errors, tripped_at: the event that made errors exceed `most`; null while active. Successes do not reset the count."""
    w = W.partitionBy("client").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    n = events.where(~F.col("ok")).withColumn("k", F.count("*").over(w))
    trip = n.groupBy("client").agg(F.max("k").alias("errors"), F.min(F.when(F.col("k") == most + 1, F.col("ts"))).alias("tripped_at"))
    return events.select("client").distinct().join(trip, "client", "left").select("client", F.coalesce("errors", F.lit(0)).alias("errors"), "tripped_at")


def client_state(events: DataFrame, now: Column, limit: int = RATE_LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """client, provider, active_requests, errors, queued, last_used, has_room (the rate allows a request) and available at `now`."""
    old = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) >= window_s * 1_000_000
    recent = W.partitionBy("client").orderBy(F.desc("ts"), F.desc("event_id"))
    r = events.withColumn("k", F.row_number().over(recent))
    s = r.groupBy("client", "provider").agg(F.sum((~F.col("ok")).cast("bigint")).alias("errors"), F.least(F.count("*"), F.lit(limit)).alias("queued"), F.max("ts").alias("last_used"), F.max(F.when(F.col("k") == limit, old)).alias("free"))
    return s.select("client", "provider", F.lit(0).cast("bigint").alias("active_requests"), "errors", "queued", "last_used", F.coalesce("free", F.lit(True)).alias("has_room"), ((F.col("errors") <= MOST_ERRORS) & F.coalesce("free", F.lit(True))).alias("available"))


def best_client(states: DataFrame, limit: int = RATE_LIMIT) -> DataFrame:
    """One row: the available client with fewest active requests, then fewest errors, then most room, then longest unused, then the
    smallest name. No row if none is available."""
    rank = F.struct(F.col("active_requests"), F.col("errors"), -(F.lit(limit) - F.col("queued")), F.col("last_used"), F.col("client"))
    return states.where("available").agg(F.min_by("client", rank).alias("client")).where("client is not null")


def client_stats(events: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """provider, client, requests, tokens, errors, is_active."""
    g = events.groupBy("provider", "client").agg(F.sum(F.col("ok").cast("bigint")).alias("requests"), F.sum(F.when(F.col("ok"), F.col("tokens")).otherwise(0)).alias("tokens"), F.sum((~F.col("ok")).cast("bigint")).alias("errors"))
    return g.withColumn("is_active", F.col("errors") <= most)


def reactivated(states: DataFrame) -> DataFrame:
    """What a health check does to client_state: clients that errors made inactive start anew; what active ones have counted stays."""
    down = F.col("errors") > MOST_ERRORS
    return states.withColumns({"errors": F.when(down, 0).otherwise(F.col("errors")).cast("bigint"), "available": F.when(down, F.col("has_room")).otherwise(F.col("available"))})


def chat_request(messages: Column, model: Column, extra: dict[str, Column] | None = None, reserved: tuple[str, ...] = ("temperature", "top_p", "top_k", "frequency_penalty")) -> Column:
    """The request as JSON; reserved parameters are not sent."""
    more = [v.alias(k) for k, v in (extra or {}).items() if k not in reserved]
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), *more))


def response_content(response: Column) -> Column:
    """The first choice's text of a JSON response, or null."""
    return F.get(F.from_json(response, RESPONSE)["choices"], F.lit(0))["message"]["content"]


def response_tokens(response: Column) -> Column:
    return F.coalesce(F.from_json(response, RESPONSE)["usage"]["total_tokens"], F.lit(0))


def response_embedding(response: Column) -> Column:
    return F.get(F.from_json(response, RESPONSE)["data"], F.lit(0))["embedding"]


class Balancer:
    """The driver-side form: clients of a configuration (see sources.settings), each behind a responder."""

    def __init__(self, clients: list[dict], clock=None, sleep=None):
        import time

        self.clock, self.sleep = clock or time.time, sleep or time.sleep
        self.clients = [{"provider": c["provider"], "limit": int(c.get("rate_limit", RATE_LIMIT)), "quota": c.get("quota"), "call": c["call"], "active": True, "running": 0, "errors": 0, "tokens": 0, "requests": 0, "last_used": 0.0, "starts": []} for c in clients]

    def available(self, c: dict) -> bool:
        return c["active"] and not (len(c["starts"]) >= c["limit"] and self.clock() - c["starts"][-c["limit"]] < WINDOW_S)

    def best(self) -> dict:
        free = [(c["running"], c["errors"], -(c["limit"] - min(len(c["starts"]), c["limit"])), c["last_used"], i) for i, c in enumerate(self.clients) if self.available(c)]
        if not free:
            raise LookupError("no client is available")
        return self.clients[min(free)[-1]]

    def request(self, payload, retry: str = "fixed"):
        """Sends payload to the best client; `fixed` tries three times, `infinite` until it works, a second apart."""
        if retry not in ("fixed", "infinite"):
            raise ValueError(f"unknown retry {retry}")
        tries = 0
        while True:
            client = None
            try:
                client = self.best()
                client["running"] += 1
                try:
                    response = client["call"](payload)
                finally:
                    client["running"] -= 1
                client["tokens"] += (response.get("usage") or {}).get("total_tokens", 0)
                client["requests"] += 1
                client["last_used"] = self.clock()
                client["starts"].append(self.clock())
                return response
            except Exception:
                if client is not None:
                    client["errors"] += 1
                    client["active"] = client["errors"] <= MOST_ERRORS
                tries += 1
                if retry == "fixed" and tries == 3:
                    raise
                self.sleep(1.0)

    def chat(self, messages: list[dict], **options) -> dict:
        return self.request({"messages": messages, **options})

    def generate(self, prompt: str, **options) -> str:
        return self.chat([{"role": "user", "content": prompt}], **options)["choices"][0]["message"]["content"]

    def embedding(self, text: str, **options) -> list[float]:
        return self.request({"input": text, **options})["data"][0]["embedding"]

    def health_check(self) -> None:
        """Clients that errors made inactive start anew; what active ones have counted stays."""
        for c in self.clients:
            if not c["active"]:
                c["active"], c["errors"] = True, 0

    def stats(self) -> dict:
        out: dict = {}
        for c in self.clients:
            out.setdefault(c["provider"], []).append({k: c[k] for k in ("requests", "tokens", "errors", "active")})
        return out


def timed(balancer: Balancer, questions: list[str], workers: int = 10) -> dict:
    """Throughput of questions sent together by `workers` threads and one by one; failures are counted as such."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    def one(q):
        try:
            balancer.generate(q)
            return True
        except Exception:  # noqa: BLE001
            return False

    out = {}
    for name, n in (("parallel", workers), ("sequential", 1)):
        began = time.time()
        with ThreadPoolExecutor(n) as pool:
            good = sum(pool.map(one, questions))
        s = max(time.time() - began, 1e-9)
        out[name] = {"success": good, "failed": len(questions) - good, "seconds": s, "qps": good / s}
    return out
