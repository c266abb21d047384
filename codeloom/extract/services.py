"""Routes, outbound calls, messaging and environment reads of scanned sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .scan import NAME, Source

#: Methods of routers and clients, receivers that are routers, procedure builders and client ends of remote
#: procedures, client ends of query documents, and receivers of messaging libraries.
ROUTER_METHODS = frozenset("get post put patch delete head options all use".split())
CLIENT_METHODS = frozenset("get post put patch delete head options request".split())
ROUTERS = frozenset("app router Router server fastify expressApp expressRouter api apiRouter".split())
PROCEDURES = frozenset("procedure publicProcedure protectedProcedure authedProcedure adminProcedure baseProcedure loggedProcedure".split())
PROCEDURE_ENDS = {"query": "query", "mutate": "mutation", "useQuery": "query", "useMutation": "mutation", "useInfiniteQuery": "query", "useSuspenseQuery": "query", "useSubscription": "subscription", "subscribe": "subscription"}
DOCUMENT_ENDS = {"query": "query", "mutate": "mutation", "mutation": "mutation", "subscribe": "subscription", "useQuery": "query", "useMutation": "mutation", "useSubscription": "subscription", "useLazyQuery": "query"}
DOCUMENT_CLIENTS = frozenset("client apollo apolloClient gqlClient urql urqlClient".split())
PROXIES = frozenset("trpc api client rpc".split())
MESSAGING = {
    "kafka": "producer kafkaProducer consumer kafkaConsumer kafka".split(), "rabbitmq": "channel amqp rabbit rabbitmq ch".split(),
    "nats": "nc nats natsClient jetstream".split(), "redis_pubsub": "redis redisClient pubsub publisher subscriber".split(),
}
GO_VERBS = {"Get": "GET", "Post": "POST", "PostForm": "POST", "Head": "HEAD", "Patch": "PATCH", "Put": "PUT", "Delete": "DELETE"}
SPRING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}
JAVA_CLIENTS = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "delete": "DELETE", "exchange": "ANY", "uri": "ANY", "newBuilder": "ANY"}
CSHARP_CLIENTS = {f"{v}{x}Async": v.upper() for v in ("Get", "Post", "Put", "Patch", "Delete") for x in ("", "AsJson", "FromJson", "String", "Stream", "ByteArray")} | {"SendAsync": "ANY"}


def http_target(raw: str) -> bool:
    """Whether text looks like a URL or a path."""
    return bool(re.match(r"(?:https?|wss?)://|/(?!/)", raw)) or bool(re.match(r"[\w.-]+(?::\d+)?/[\w/:{}.?=&%-]*$", raw) and "." in raw.split("/")[0])


def hints(receiver: str | None, protocol: str) -> bool:
    """Whether a receiver is named as the library's objects are, or ends so."""
    return receiver is not None and any(receiver == h or receiver.lower().endswith(h.lower()) for h in MESSAGING[protocol] if len(h) > 2 or receiver == h)


def queue_name(url: str) -> str:
    return url.rsplit("/", 1)[-1]


def topic_name(arn: str) -> str:
    return arn.rsplit(":", 1)[-1]


def template(raw: str) -> tuple[str, str | None]:
    """A template's text with a parameter for each inserted expression, and the environment key at its head."""
    env = re.match(r"\$\{\s*(?:process\.env|import\.meta\.env)\.(\w+)\s*\}|\$\{\s*([A-Z][A-Z0-9_]*)\s*\}", raw)
    if env:
        raw = raw[env.end() :]
    return re.sub(r"\$\{[^}]*\}", ":param", raw), (env[1] or env[2]) if env else None


def name_of(src: Source, span: tuple[int, int]) -> str | None:
    """The name of a span that is an identifier or a chain of members: its last part."""
    m = re.compile(rf"(?:{NAME}\.)*({NAME})$").fullmatch(src.code[span[0] : span[1]])
    return m[1] if m else None


def _is_function(src: Source, span: tuple[int, int]) -> bool:
    return bool(re.match(rf"(?:async\s+)?(?:function\b|\(|{NAME}\s*=>)", src.code[span[0] : span[1]])) and ("=>" in src.code[span[0] : span[1]] or "function" in src.code[span[0] : span[1]])


def _receiver(src: Source, dot: int) -> tuple[str | None, list[str], bool]:
    """(root, members, plain) of the chain before a point: `plain` if it is one identifier."""
    parts, at, plain = [], dot, True
    while True:
        end = len(src.code[:at].rstrip())
        if end and src.code[end - 1] == ")":
            opens = next((i for i, j in src.pair.items() if j == end - 1), None)
            if opens is None:
                return None, parts, False
            at, plain = opens, False
            m = re.search(rf"({NAME})\s*(?:<[^()]*>)?$", src.code[max(0, at - 80) : at])
            if not m:
                return None, parts, False
            parts.insert(0, m[1] + "()")
            at = at - (len(src.code[max(0, at - 80) : at]) - m.start(1))
        else:
            m = re.search(rf"({NAME})\s*$", src.code[max(0, end - 80) : end])
            if not m:
                return None, parts, False
            parts.insert(0, m[1])
            at = end - (len(src.code[max(0, end - 80) : end]) - m.start(1))
        before = src.code[:at].rstrip()
        if before.endswith("."):
            at = len(before) - 1
            if before.endswith("?."):
                at -= 1
            plain = False
            continue
        return parts[0], parts[1:], plain and len(parts) == 1


def document(raw: str) -> tuple[str | None, str | None]:
    """(operation's name, its first field) of a query document."""
    body = re.sub(r"#[^\n]*", " ", raw)
    m = re.search(r"\b(?:query|mutation|subscription)\b\s*(\w+)?\s*(?:\([^)]*\))?[^{]*\{\s*(?:\w+\s*:\s*)?(\w+)", body) or re.match(r"\s*()\{\s*(?:\w+\s*:\s*)?(\w+)", body)
    return (m[1] or None, m[2]) if m else (None, None)


def script_services(src: Source) -> Iterator[tuple[str, dict, int]]:
    """(table, row, place) of routes, service_calls and config_keys of a script. A call that registers a route is none."""
    code = src.code
    for m in re.finditer(rf"(?:(\.)\s*|(?<![\w$.]))({NAME})\s*(?:<[^<>()]*>)?\(", code):
        open_, name = m.end() - 1, m[2]
        args = src.arguments(open_)
        line = src.line(m.start())
        root, members, plain = _receiver(src, m.start()) if m[1] else (None, [], False)
        receiver = root if plain else None
        found = list(_script_call(src, m, name, args, root, members, receiver))
        routes = [x for x in found if x[0] == "routes"]
        for table, row in routes or found[:1]:
            yield table, {"line": line, **row}, m.start()
    for m in re.finditer(rf"(?<![\w$])({NAME})\s*(?::[^=;(){{}}]+)?=\s*(?=\{{|gql\b|graphql\b)", code):
        at = src.skip(m.end())
        if code[at] == "{":
            end = src.close(at)
            kinds = src.fields((at, end)) if end else {}
            for kind in ("Query", "Mutation", "Subscription"):
                for key, span in src.fields(kinds[kind]).items() if kind in kinds else ():
                    handler = name_of(src, span) if code[span[0] : span[1]] != key else key
                    own = re.match(rf"(?:async\s+)?{re.escape(key)}\s*\(", code[span[0] : span[1]])
                    yield "routes", {"method": kind.upper(), "path": key, "framework": "graphql", "handler_name": key if own else handler, "protocol": "graphql", "operation": key, "line": src.line(span[0])}, span[0]
        else:
            tag = re.compile(r"(?:gql|graphql)\s*").match(code, at)
            if tag and tag.end() in src.strings:
                name, first = document(src.strings[tag.end()][1])
                if first or name:
                    yield "service_calls", {"protocol": "graphql", "method": "DOCUMENT", "raw_target": m[1], "framework": "gql-doc", "confidence": 0.9, "operation": first or name, "line": src.line(m.start())}, m.start()
    for m in re.finditer(rf"\b(?:process|import\s*\.\s*meta)\s*\.\s*env\s*(?:\.\s*({NAME})|\[\s*(?=\"))", code):
        key = m[1] or src.strings.get(m.end(), (0, ""))[1]
        if key and (m[1] or code.startswith("process", m.start())):
            yield "config_keys", {"key": key, "source": "env", "line": src.line(m.start())}, m.start()


def _script_call(src: Source, m: re.Match, name: str, args: list, root: str | None, members: list[str], receiver: str | None) -> Iterator[tuple[str, dict]]:
    first = src.literal(args[0]) if args else None
    raw_first = src.code[args[0][0] : args[0][1]] if args else ""
    options = src.fields(args[0]) if args and raw_first.startswith("{") else {}
    field = lambda k: src.literal(options[k]) if k in options else None
    chain = [x.removesuffix("()") for x in ([root] if root else []) + members]
    if m[1] and args:
        if name in ("query", "mutation", "subscription") and set(chain) & PROCEDURES:
            key = _pair_key(src, m.start())
            if key:
                yield "routes", {"method": name.upper(), "path": key, "framework": "trpc", "handler_name": name_of(src, args[0]), "protocol": "trpc", "operation": key}
        yield from _consumer(src, name, args, receiver, first, options)
        if name == "route" and options:
            url, many = field("url"), options.get("method")
            methods = [] if many is None else [src.literal(many)] if src.literal(many) else [src.literal(x) for x in src.arguments(many[0])]
            if url and len(url) <= 200:
                for method in filter(None, methods):
                    yield "routes", {"method": method.upper(), "path": url, "framework": "fastify", "handler_name": name_of(src, options["handler"]) if "handler" in options else None, "protocol": "http"}
        handlers = [a for a in args[1:] if name_of(src, a) or _is_function(src, a)]
        if name.lower() in ROUTER_METHODS and first and len(first) <= 200 and (receiver in ROUTERS or handlers):
            names = []
            for a in reversed(args[1:]):
                names.append(name_of(src, a))
                if names[-1] or _is_function(src, a):
                    break
            yield "routes", {"method": name.upper(), "path": first, "framework": "express", "handler_name": next(filter(None, names), None), "protocol": "http"}
    pure = not any(x.endswith("()") for x in members) and root is not None and not root.endswith("()")
    if m[1] and name in PROCEDURE_ENDS and pure and members and (root in PROXIES or root.lower().startswith("trpc") or root.lower().endswith("trpc")):
        operation = ".".join(members)
        yield "service_calls", {"protocol": "trpc", "method": PROCEDURE_ENDS[name].upper(), "raw_target": operation, "framework": f"trpc-{name}", "confidence": 0.9, "operation": operation}
    if name in DOCUMENT_ENDS and args and (not m[1] or receiver in DOCUMENT_CLIENTS):
        kind = DOCUMENT_ENDS[name]
        span = options.get(kind) if options else args[0]
        if span:
            ident = re.compile(NAME).fullmatch(src.code[span[0] : span[1]])
            tag = re.compile(r"(?:gql|graphql)\s*").match(src.code, span[0])
            body = src.strings.get(tag.end()) if tag else None
            op, top = document(body[1]) if body else (None, None)
            operation = top or op or (ident.group() if ident else None)
            if operation:
                yield "service_calls", {"protocol": "graphql", "method": kind.upper(), "raw_target": ident.group() if ident else src.text[span[0] : span[1]][:240], "framework": f"graphql-{name}", "confidence": 0.9 if top else 0.85 if op else 0.65, "operation": operation}
    if m[1] and args:
        yield from _producer(src, name, args, receiver, first, options, field)
    low = name.lower()
    if (not m[1] and name == "fetch") or (m[1] and low in CLIENT_METHODS):
        if first is not None:
            quote = src.text[args[0][0]]
            raw, env = template(first) if quote == "`" else (first, None)
            if raw and http_target(raw):
                method = None if name == "fetch" else "ANY" if low == "request" else low.upper()
                if name == "fetch" and len(args) > 1:
                    more = src.fields(args[1])
                    method = (src.literal(more["method"]) or "").upper() or None if "method" in more else None
                yield "service_calls", {"protocol": "http", "method": method or "ANY", "raw_target": raw[:240], "framework": "fetch" if name == "fetch" else "axios" if receiver == "axios" else "http-client", "confidence": 0.85, "env_key": env}


def _pair_key(src: Source, at: int) -> str | None:
    """The key of the object member that a place is the value of."""
    i = at
    while i > 0:
        i -= 1
        c = src.code[i]
        if c in CLOSERS:
            opens = next((a for a, b in src.pair.items() if b == i), None)
            if opens is None:
                return None
            i = opens
        elif c in "({[,;":
            return None
        elif c == ":":
            m = re.search(rf"({NAME}|\"\s*\")\s*$", src.code[:i])
            return None if not m else src.strings[m.start(1)][1] if m.start(1) in src.strings else m[1]
    return None


CLOSERS = ")]}"


def _consumer(src: Source, name: str, args: list, receiver: str | None, first: str | None, options: dict) -> Iterator[tuple[str, dict]]:
    row = lambda protocol, framework, path, **more: ("routes", {"method": "CONSUME", "path": path, "framework": framework, "protocol": protocol, **more})
    if name == "subscribe" and options and hints(receiver, "kafka"):
        one = src.literal(options["topic"]) if "topic" in options else None
        many = [src.literal(x) for x in src.arguments(options["topics"][0])] if "topics" in options and src.code[options["topics"][0]] == "[" else []
        for topic in filter(None, [one] if one else many):
            yield row("kafka", "kafkajs", topic, topic=topic)
    elif name == "subscribe" and first is not None and hints(receiver, "nats"):
        yield row("nats", "nats", first, topic=first)
    elif name == "subscribe" and first is not None and hints(receiver, "redis_pubsub"):
        yield row("redis_pubsub", "redis", first, topic=first)
    elif name == "consume" and first is not None and hints(receiver, "rabbitmq"):
        yield row("rabbitmq", "amqplib", first, queue=first, handler_name=name_of(src, args[1]) if len(args) > 1 else None)
    elif name == "receiveMessage" and "QueueUrl" in options and (url := src.literal(options["QueueUrl"])) is not None:
        yield row("sqs", "aws-sdk-sqs", url, queue=queue_name(url))


def _producer(src: Source, name: str, args: list, receiver: str | None, first: str | None, options: dict, field) -> Iterator[tuple[str, dict]]:
    row = lambda protocol, framework, raw, **more: ("service_calls", {"protocol": protocol, "method": "PUBLISH", "raw_target": raw[:240], "framework": framework, "confidence": 0.9, **more})
    if name == "send" and field("topic"):
        yield row("kafka", "kafkajs", field("topic"), topic=field("topic"))
    elif name == "send" and first and hints(receiver, "kafka"):
        yield row("kafka", "kafka", first, topic=first)
    elif name == "sendMessage" and field("QueueUrl") is not None:
        yield row("sqs", "aws-sdk-sqs", field("QueueUrl"), queue=queue_name(field("QueueUrl")))
    elif name == "sendToQueue" and first:
        yield row("rabbitmq", "amqplib", first, queue=first)
    elif name == "publish" and field("TopicArn") is not None:
        yield row("sns", "aws-sdk-sns", field("TopicArn"), topic=topic_name(field("TopicArn")))
    elif name == "publish" and first is not None and hints(receiver, "rabbitmq"):
        yield row("rabbitmq", "amqplib", first, exchange=first)
    elif name == "publish" and first is not None and hints(receiver, "nats"):
        yield row("nats", "nats", first, topic=first)
    elif name == "publish" and first is not None and hints(receiver, "redis_pubsub"):
        yield row("redis_pubsub", "redis", first, topic=first)


def go_services(src: Source) -> Iterator[tuple[str, dict, int]]:
    """Outbound HTTP requests, and calls through constructed remote clients."""
    for m in re.finditer(r"\.\s*(\w+)\s*\(", src.code):
        args, name = src.arguments(m.end() - 1), m[1]
        root, members, plain = _receiver(src, m.start())
        last = ([root] if root else []) + members
        made = re.fullmatch(r"New([A-Z]\w*?)(Service)?Client\(\)", last[-1]) if last else None
        line = src.line(m.start())
        if made and name[0].isupper():
            service = made[1] + (made[2] or "")
            yield "service_calls", {"protocol": "grpc", "method": name.upper(), "raw_target": f"{last[-1][:-2]}.{name}", "framework": "grpc-go", "confidence": 0.9, "operation": f"{service}/{name}", "service": service, "line": line}, m.start()
            continue
        new = name == "NewRequest"
        url = src.literal(args[1 if new else 0]) if len(args) > new and (name in GO_VERBS or new) else None
        if url and http_target(url):
            method = (src.literal(args[0]) or "ANY").upper() if new else GO_VERBS[name]
            yield "service_calls", {"protocol": "http", "method": method, "raw_target": url[:240], "framework": root if plain and root in ("http", "httputil") else "http-client", "confidence": 0.85, "line": line}, m.start()


def join_paths(prefix: str, path: str) -> str:
    """A class's and a method's path as one."""
    if not prefix or not path:
        return prefix or path
    return f"{prefix.rstrip('/')}/{path.lstrip('/')}"


def java_services(src: Source) -> Iterator[tuple[str, dict, int]]:
    """Annotated routes, with their class's prefix; outbound requests; environment reads."""
    prefixes, found = [], []
    for m in re.finditer(r"@(\w+Mapping)\b\s*", src.code):
        args = src.arguments(m.end()) if src.code[m.end() : m.end() + 1] == "(" else []
        after = (src.close(m.end()) if src.code[m.end() : m.end() + 1] == "(" else m.end()) or m.end()
        path, method = "", SPRING.get(m[1])
        for a in args:
            pair = re.compile(r"(\w+)\s*=\s*").match(src.code, a[0])
            span = (pair.end(), a[1]) if pair else a
            if not pair or pair[1] in ("value", "path"):
                values = src.arguments(span[0]) if src.code[span[0]] == "{" else [span]
                path = path or next(filter(None, (src.literal(v) for v in values)), "")
            elif pair[1] == "method":
                method = re.sub(r".*RequestMethod\.|[,}\s]", "", src.code[span[0] : span[1]]) or method
        while True:  # over further annotations
            more = re.compile(r"\s*@\w+\s*").match(src.code, after)
            if not more:
                break
            after = more.end()
            if src.code[after : after + 1] == "(":
                after = src.close(after) or after + 1
        owner = re.compile(rf"\s*(?:(?:public|protected|private|final|abstract|static)\s+)*(?:(class|interface)\s+|(?:<[^>]*>\s*)?[\w.<>\[\],?\s]+?\s)({NAME})").match(src.code, after)
        if owner and owner[1]:
            brace = src.code.find("{", owner.end())
            prefixes.append((brace, src.close(brace) or len(src.code), path))
        elif owner and (method or m[1] == "RequestMapping"):
            found.append((m.start(), method or "GET", path, owner[2]))
    for at, method, path, handler in found:
        inside = [p for b, e, p in prefixes if b < at < e]
        full = join_paths(inside[-1] if inside else "", path)
        if full:
            yield "routes", {"method": method, "path": full, "framework": "spring", "handler_name": handler, "protocol": "http", "line": src.line(at)}, at
    for m in re.finditer(r"\.\s*(\w+)\s*\(", src.code):
        args, root = src.arguments(m.end() - 1), _receiver(src, m.start())[0]
        if root == "System" and m[1] == "getenv" and args and src.literal(args[0]):
            yield "config_keys", {"key": src.literal(args[0]), "source": "env", "line": src.line(m.start())}, m.start()
        elif m[1] in JAVA_CLIENTS and args:
            made = re.compile(r"URI\s*\.\s*create\s*\(").match(src.code, args[0][0])
            inner = src.arguments(made.end() - 1) if made else args
            url = src.literal(inner[0]) if inner else None
            if url and http_target(url):
                yield "service_calls", {"protocol": "http", "method": JAVA_CLIENTS[m[1]], "raw_target": url[:240], "framework": "java.net.http" if root == "HttpRequest" else "spring-rest" if root and "resttemplate" in root.lower() else "http-client", "confidence": 0.8, "line": src.line(m.start())}, m.start()


def csharp_services(src: Source) -> Iterator[tuple[str, dict, int]]:
    for m in re.finditer(r"\.\s*(\w+)\s*(?:<[\w<>,.\s]*>)?\s*\(", src.code):
        args = src.arguments(m.end() - 1)
        url = src.literal(args[0]) if args and m[1] in CSHARP_CLIENTS else None
        if url and http_target(url):
            yield "service_calls", {"protocol": "http", "method": CSHARP_CLIENTS[m[1]], "raw_target": url[:240], "framework": "HttpClient", "confidence": 0.8, "line": src.line(m.start())}, m.start()


SERVICES = {"javascript": script_services, "typescript": script_services, "go": go_services, "java": java_services, "csharp": csharp_services}
