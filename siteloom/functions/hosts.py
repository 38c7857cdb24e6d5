"""Hosts: registrable domains, identity of a website, scope of a crawl and addresses that must not be contacted."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from siteloom.functions.rules import DEFAULT, WEBSITE, Rejected, UrlRules
from siteloom.functions.urls import Url, normalise

#: Second-level suffixes by country, and platforms whose subdomains have different owners.
SECOND_LEVEL = {
    "uk": "co org me ltd plc net ac gov sch", "au": "com net org edu gov asn id", "nz": "co org net ac govt school", "jp": "co ne or ac go ed",
    "kr": "co or ne go ac", "cn": "com net org gov edu", "hk": "com org edu gov net", "tw": "com org edu gov net", "sg": "com org edu gov net",
    "in": "co net org ac gov edu firm gen ind", "my": "com org edu gov net", "id": "co or ac go web", "th": "co in ac go", "ph": "com org edu gov net",
    "vn": "com net org edu gov", "pk": "com org edu gov net", "bd": "com org edu gov net", "az": "com org net edu gov", "ge": "com org edu gov",
    "il": "co org ac gov net", "tr": "com org edu gov net", "sa": "com org edu gov net", "eg": "com org edu gov net", "za": "co org ac gov net",
    "ke": "co or ac go", "ng": "com org edu gov net", "br": "com net org gov edu", "ar": "com org gob edu net", "mx": "com org gob edu net",
    "co": "com org edu gov net", "pe": "com org edu gob net", "ve": "com", "uy": "com", "ec": "com", "ua": "com org net gov edu kiev",
    "pl": "com org net edu gov", "ru": "com org net", "at": "co or ac gv", "pt": "com org edu gov", "gr": "com org edu gov net",
    "es": "com org nom gob edu", "de": "com", "fr": "com asso gouv", "hu": "co org", "ro": "com org",
}
PLATFORMS = (
    "github.io gitlab.io herokuapp.com blogspot.com wordpress.com netlify.app vercel.app pages.dev workers.dev web.app firebaseapp.com "
    "azurewebsites.net cloudfront.net appspot.com myshopify.com wixsite.com weebly.com squarespace.com s3.amazonaws.com elasticbeanstalk.com "
    "onrender.com fly.dev glitch.me repl.co surge.sh ngrok.io ngrok-free.app tumblr.com webflow.io carrd.co notion.site readthedocs.io"
).split()
SUFFIXES = frozenset([f"{s}.{country}" for country, names in SECOND_LEVEL.items() for s in names.split()] + PLATFORMS)

#: Labels of subdomains that lead to people and companies, and of those that are infrastructure.
RELEVANT = frozenset(
    "www about aboutus team teams people staff contact contacts company corporate careers career jobs blog news press investors investor ir "
    "faculty directory leadership management info home main global international en".split()
)
INFRASTRUCTURE = frozenset(
    "mail email webmail smtp imap pop pop3 mx ns ns1 ns2 dns ftp sftp cdn static assets img images image media files download downloads api "
    "dev stage staging test qa uat sandbox demo git gitlab svn vpn remote admin cpanel whm autodiscover autoconfig status monitor grafana "
    "jenkins ci intranet internal login sso auth portal".split()
)
_LABEL_BY_SHAPE = re.compile(r"www\d*|[a-z]{2}(?:-[a-z]{2})?")

#: Names of internal hosts and their endings, services that resolve to any address, metadata services, networks.
INTERNAL_HOSTS = frozenset(
    "localhost localhost.localdomain ip6-localhost ip6-loopback broadcasthost metadata metadata.google.internal instance-data "
    "instance-data.ec2.internal kubernetes kubernetes.default kubernetes.default.svc".split()
)
INTERNAL_ENDINGS = tuple(
    ".localhost .local .localdomain .internal .intranet .lan .home.arpa .corp .home .private .svc .cluster.local .in-addr.arpa .ip6.arpa".split()
)
WILDCARD_DNS = "nip.io sslip.io xip.io localtest.me lvh.me vcap.me lacolhost.com traefik.me localho.st".split()
METADATA_ADDRESSES = frozenset("169.254.169.254 169.254.170.2 100.100.100.200 168.63.129.16 192.0.0.192 fd00:ec2::254".split())
NETWORKS = [
    (ipaddress.ip_network(n), reason)
    for reason, networks in (
        ("unspecified", "0.0.0.0/8 ::/128"),
        ("private", "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 fc00::/7 fec0::/10"),
        ("cgnat", "100.64.0.0/10"),
        ("loopback", "127.0.0.0/8 ::1/128"),
        ("link_local", "169.254.0.0/16 fe80::/10"),
        ("reserved", "192.0.0.0/24 192.88.99.0/24 240.0.0.0/4 100::/64"),
        ("documentation", "192.0.2.0/24 198.51.100.0/24 203.0.113.0/24 2001:db8::/32"),
        ("benchmarking", "198.18.0.0/15"),
        ("multicast", "224.0.0.0/4 ff00::/8"),
        ("teredo", "2001::/32"),
    )
    for n in networks.split()
]
_HOLDING_IPV4 = [ipaddress.ip_network(n) for n in ("64:ff9b::/96", "::ffff:0:0:0/96")]

Address = ipaddress.IPv4Address | ipaddress.IPv6Address


def parse_ip(text: str) -> Address | None:
    """An IP address, with or without brackets and zone; None for other hosts."""
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    try:
        return ipaddress.ip_address(text.partition("%")[0])
    except ValueError:
        return None


def registered_domain(host: str, extra: frozenset[str] = frozenset()) -> str | None:
    """The registrable domain; None for a public suffix; IP addresses and single labels as they are."""
    labels = host.split(".")
    if len(labels) == 1 or parse_ip(host) is not None:
        return host
    known = (n for n in (3, 2) if n <= len(labels) and (s := ".".join(labels[-n:])) and (s in SUFFIXES or s in extra))
    n = next(known, 1)
    return ".".join(labels[-n - 1 :]) if len(labels) > n else None


def is_domain_or_below(host: str, domain: str) -> bool:
    return f".{host}".endswith(f".{domain}")


class Scope(NamedTuple):
    allowed: bool
    reason: str | None = None
    detail: str = ""


def is_relevant(labels: Iterable[str], rules: UrlRules = DEFAULT) -> bool:
    """Whether a subdomain may lead to content: none of its labels is infrastructure, all are known or locales."""
    labels = list(labels)
    if any(x in INFRASTRUCTURE or x in rules.extra_blocked_labels for x in labels):
        return False
    return all(x in RELEVANT or x in rules.extra_relevant_labels or _LABEL_BY_SHAPE.fullmatch(x) for x in labels)


def check_scope(host: str, seed: str, rules: UrlRules = DEFAULT) -> Scope:
    """Whether a crawl that began at host ``seed`` may go to ``host``; both are normalised."""
    blocked = next((d for d in sorted(rules.blocked_domains) if is_domain_or_below(host, d)), None)
    if blocked is not None:
        return Scope(False, "blocked_domain", blocked)
    if host == seed:
        return Scope(True)
    if parse_ip(host) or parse_ip(seed):
        return Scope(False, "out_of_scope", "ip hosts only match exactly")
    own = registered_domain(host, rules.extra_public_suffixes)
    if own is None:
        return Scope(False, "public_suffix", host)
    if own != registered_domain(seed, rules.extra_public_suffixes) and own not in rules.scope_domains:
        return Scope(False, "out_of_scope", own)
    twins = host.removeprefix("www.") == seed.removeprefix("www.")
    labels = host.removesuffix(own).rstrip(".")
    fits = {"exact": False, "www": twins, "all": True, "relevant": twins or is_relevant(filter(None, labels.split(".")), rules)}
    if fits[rules.subdomain_mode]:
        return Scope(True)
    return Scope(False, "subdomain_not_relevant", labels if rules.subdomain_mode == "relevant" else f"{rules.subdomain_mode} mode")


def ip_block_reason(ip: Address) -> str | None:
    """Why an address must not be contacted; None for public ones. IPv4 inside IPv6 counts as IPv4."""
    if ip.version == 6:
        inner = ip.ipv4_mapped or ip.sixtofour
        if inner is None and (any(ip in n for n in _HOLDING_IPV4) or 1 < int(ip) < 1 << 32):
            inner = ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)
        if inner is not None:
            return ip_block_reason(inner)
    if str(ip) in METADATA_ADDRESSES:
        return "metadata"
    held = next((reason for n, reason in NETWORKS if n.version == ip.version and ip in n), None)
    return held or (None if ip.is_global else "non_global")


def host_block_reason(host: str, rules: UrlRules = DEFAULT) -> str | None:
    """Why a normalised host must not be contacted, without looking it up. Metadata services never may."""
    ip = parse_ip(host)
    if ip is not None:
        reason = ip_block_reason(ip)
    elif host in INTERNAL_HOSTS or host.endswith(INTERNAL_ENDINGS):
        reason = "internal_hostname"
    elif any(is_domain_or_below(host, d) for d in WILDCARD_DNS):
        reason = "wildcard_dns"
    else:
        reason = "single_label" if rules.block_single_label_hosts and "." not in host else None
    return reason if reason == "metadata" or not rules.ssrf_allow_private_networks else None


def addresses_block_reason(addresses: Iterable[str], rules: UrlRules = DEFAULT) -> str | None:
    """Why a host with these addresses must not be contacted: one bad address is enough."""
    reasons, some = [], False
    for text in addresses:
        some, ip = True, parse_ip(text)
        reason = "invalid_address" if ip is None else ip_block_reason(ip)
        if reason and (reason in ("invalid_address", "metadata") or not rules.ssrf_allow_private_networks):
            reasons.append(reason)
    return reasons[0] if reasons else None if some else "unresolvable"


def resolve_and_check(host: str, resolver: Callable[[str], Iterable[str]], rules: UrlRules = DEFAULT) -> list[str]:
    """Addresses of a host that may be contacted; raises ``Rejected`` for others."""
    reason = host_block_reason(host, rules)
    if reason:
        raise Rejected("ssrf_blocked", reason)
    if parse_ip(host) is not None:
        return [host.strip("[]")]
    try:
        addresses = list(resolver(host))
    except OSError:
        addresses = []
    reason = addresses_block_reason(addresses, rules)
    if reason:
        raise Rejected("ssrf_blocked", reason if reason == "unresolvable" else f"resolves_to_{reason}")
    return addresses


class Identity(NamedTuple):
    """What a website is known by: ``domain`` is the key of its business."""

    domain: str
    host: str
    website: str
    scheme: str
    port: int | None
    path: str


def identity_of_host(host: str, extra: frozenset[str] = frozenset()) -> str:
    """Key of a normalised host: its registrable domain, never with ``www.`` unless that is the domain's own name."""
    if parse_ip(host) is not None:
        return host.strip("[]")
    own = registered_domain(host, extra)
    if own is None:
        return host
    rest = own.removeprefix("www.")
    return rest if rest != own and "." in rest and registered_domain(rest, extra) is None else own


def identify(value: object, *, default_scheme: str | None = "https", extra: frozenset[str] = frozenset()) -> Identity:
    """Identity of a website in any spelling; raises ``Rejected``."""
    if not isinstance(value, str):
        raise Rejected("invalid_url", "not a string")
    text = value.strip()
    if ":" in text and "/" not in text and "[" not in text:
        ip = parse_ip(text)
        text = f"[{ip.compressed}]" if ip is not None and ip.version == 6 and "%" not in text else text
    scheme = None if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", text) else default_scheme
    n: Url = normalise(text, rules=WEBSITE, default_scheme=scheme)
    return Identity(identity_of_host(n.host, extra), n.host, n.url, n.scheme, n.port, n.path)
