"""Dissectors of text protocols, in Column expressions; bytes are read as ISO-8859-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.bytes import be, bind, cut, length, text
from flowloom.plans.registry import dissector, field_map

# Methods, commands and names from the protocols' specifications.
HTTP_METHODS = "GET POST PUT DELETE HEAD OPTIONS PATCH CONNECT TRACE"
SIP_METHODS = "INVITE ACK BYE CANCEL REGISTER OPTIONS PRACK SUBSCRIBE NOTIFY MESSAGE"
RTSP_METHODS = "OPTIONS DESCRIBE ANNOUNCE SETUP PLAY PAUSE TEARDOWN GET_PARAMETER SET_PARAMETER REDIRECT RECORD"
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp logaudit logalert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "Emergency Alert Critical Error Warning Notice Informational Debug".split()
KEX_LISTS = (
    "ssh_kex_algorithms", "ssh_server_host_key_algorithms", "ssh_encryption_algorithms_client_to_server", "ssh_encryption_algorithms_server_to_client", "ssh_mac_algorithms_client_to_server",
    "ssh_mac_algorithms_server_to_client", "ssh_compression_algorithms_client_to_server", "ssh_compression_algorithms_server_to_client",
)


def when(test, value):
    return F.when(test, value)


def starts(p: Column, words: str, tail: str = " ") -> Column:
    return text(p).rlike("^(?:" + "|".join(w.replace(".", r"\.") + tail for w in words.split()) + ")")


def first_line(t: Column, crlf_only: bool = False) -> Column:
    """The text before the first line end: CRLF if there is one anywhere, or else a bare LF."""
    if crlf_only:
        return F.substring_index(t, "\r\n", 1)
    return F.when(F.instr(t, "\r\n") > 0, F.substring_index(t, "\r\n", 1)).otherwise(F.substring_index(t, "\n", 1))


def header_lines(t: Column, limit: int) -> Column:
    """Whole lines after the first, up to an empty one."""
    lines = F.split(t, r"\r\n|\n", -1)
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    stop = F.array_position(rest, "")
    return F.slice(F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest), 1, limit)


def header(lines: Column, *names: str) -> Column:
    """The value of the last header with one of these names (lower case), without leading blanks."""
    own = F.filter(lines, lambda x: (F.instr(x, ":") > 0) & F.lower(F.substring_index(x, ":", 1)).isin(*names))
    return bind(bind(own, lambda x: F.get(x, F.size(x) - 1)), lambda x: F.ltrim(F.substring(x, F.instr(x, ":") + 1, F.length(x))))


def printable(line: Column) -> Column:
    return line.rlike(r"^[\x20-\x7e\t]*$")


@dissector("HTTP/1.1", "http1", 6, "TCP", (80,), (0.7, 0.9))
class Http1:
    def detect(p, port, l4):
        return (length(p) >= 8) & (text(p, 0, 5) == "HTTP/") | (length(p) >= 8) & starts(p, HTTP_METHODS)

    def fields(p, port, l4):
        t = text(p)
        ok = F.instr(t, "\r\n") > 0
        line = first_line(t, True)
        reply = F.substring(line, 1, 5) == "HTTP/"
        words = F.split(line, " ", -1)
        at = F.instr(t, "\r\n\r\n")
        body = F.when(at > 0, F.substring(t, at + 4, F.length(t)))
        body = F.when(body != "", body)
        path = F.get(words, F.lit(1))
        return {
            "parse_warning": when(~ok, F.lit("no_complete_first_line")),
            "http_is_response": when(ok, F.when(reply, "true").otherwise("false")),
            "http_first_line": when(ok, line),
            "http_status_code": when(ok & reply & (F.length(line) >= 12), F.substring(line, 10, 3)),
            "http_method": when(ok & ~reply, F.get(words, F.lit(0))),
            "http_path": when(ok & ~reply & (path != ""), path),
            "*": when(ok, bind(header_lines(t, 64), lambda x: field_map({"http_host": header(x, "host"), "http_user_agent": header(x, "user-agent"), "http_content_type": header(x, "content-type")}))),
            "http_body_preview": when(ok, F.substring(body, 1, 200)),
            "http_body_length": when(ok, F.length(body).cast("string")),
        }


@dissector("SIP", "sip", 10, "UDP TCP", (5060,), (0.6, 0.9))
class Sip:
    def detect(p, port, l4):
        return (length(p) >= 8) & ((text(p, 0, 7) == "SIP/2.0") | starts(p, SIP_METHODS))

    def fields(p, port, l4):
        t = text(p)
        ok = F.instr(t, "\n") > 0
        line = first_line(t)
        reply = F.substring(line, 1, 7) == "SIP/2.0"
        lines = header_lines(t, 32)
        return {
            "parse_warning": when(~ok, F.lit("no_complete_first_line")),
            "sip_is_response": when(ok, F.when(reply, "true").otherwise("false")),
            "sip_first_line": when(ok, line),
            "sip_status_code": when(ok & reply & line.rlike("^.{8}[0-9]..") , F.substring(line, 9, 3)),
            "sip_method": when(ok & ~reply, F.substring_index(line, " ", 1)),
            "sip_call_id": when(ok, header(lines, "call-id", "i")),
            "sip_from": when(ok, header(lines, "from", "f")),
            "sip_to": when(ok, header(lines, "to", "t")),
        }


@dissector("RTSP", "rtsp", 59, "TCP", (554,), (0.6, 0.9))
class Rtsp:
    def detect(p, port, l4):
        return (length(p) >= 8) & ((text(p, 0, 5) == "RTSP/") | starts(p, RTSP_METHODS))

    def fields(p, port, l4):
        t = text(p)
        ok = F.instr(t, "\n") > 0
        line = first_line(t)
        reply = F.substring(line, 1, 5) == "RTSP/"
        lines = header_lines(t, 32)
        code = F.regexp_extract(line, "^[^ ]* ([0-9]+)", 1)
        blank = F.instr(line, " ") > 0
        url = F.regexp_extract(line, "^[^ ]* ([^ ]*) ", 1)
        return {
            "parse_warning": when(~ok, F.lit("no_complete_first_line")),
            "rtsp_is_response": when(ok, F.when(reply, "true").otherwise("false")),
            "rtsp_first_line": when(ok, line),
            "rtsp_status_code": when(ok & reply & (code != ""), code),
            "rtsp_method": when(ok & ~reply & blank, F.substring_index(line, " ", 1)),
            "rtsp_url": when(ok & ~reply & line.rlike("^[^ ]* [^ ]* "), url),
            "rtsp_cseq": when(ok, header(lines, "cseq")),
            "rtsp_session": when(ok, header(lines, "session")),
            "rtsp_transport": when(ok, header(lines, "transport")),
            "rtsp_content_type": when(ok, header(lines, "content-type")),
        }


@dissector("SMTP", "smtp", 14, "TCP", (25, 587), (0.6, 0.9))
class Smtp:
    def detect(p, port, l4):
        return (length(p) >= 4) & text(p).rlike(r"^(?:[0-9]{3}[ \-]|(?i:HELO |EHLO |MAIL FROM:|RCPT TO:|DATA|QUIT|RSET|VRFY |NOOP|STARTTLS|AUTH ))")

    def fields(p, port, l4):
        # each step is bound: lines, whole lines, the place of DATA, then commands and what follows them
        whole = bind(F.split(text(p), "\r\n", -1), lambda lines: F.slice(F.slice(lines, F.lit(1), F.size(lines) - 1), 1, 32))
        return {"*": bind(whole, lambda lines: bind(F.array_position(F.transform(lines, lambda x: x.rlike("^(?i:DATA)")), True), lambda data: _smtp_parts(lines, data)))}


def _smtp_parts(whole: Column, data: Column) -> Column:
    commands = F.when(data > 0, F.slice(whole, F.lit(1), data.cast("int"))).otherwise(whole)
    after = F.slice(F.when(data > 0, F.slice(whole, (data + 1).cast("int"), 32)).otherwise(F.array().cast("array<string>")), 1, 16)

    def named(commands, mail, body):
        last = lambda test, cut_: cut_(bind(F.filter(commands, test), lambda x: F.get(x, F.size(x) - 1)))
        word = lambda w: last(lambda x: x.rlike(f"^(?i:{w})"), lambda x: F.substring(x, len(w) + 1, 1 << 20))
        seen = lambda w: when(F.exists(commands, lambda x: x.rlike(f"^(?i:{w})")), F.lit("true"))
        return field_map(
            {
                "smtp_response_code": last(lambda x: x.rlike("^[0-9]{3}."), lambda x: F.substring(x, 1, 3)),
                "smtp_helo_domain": word("HELO "),
                "smtp_ehlo_domain": word("EHLO "),
                "smtp_mail_from": word("MAIL FROM:"),
                "smtp_rcpt_to": word("RCPT TO:"),
                "smtp_data_command_seen": seen("DATA"),
                "smtp_message_body_begins": when(body, F.lit("true")),
                "smtp_message_subject": header(mail, "subject"),
                "smtp_message_from": header(mail, "from"),
                "smtp_message_to": header(mail, "to"),
                "smtp_message_date": header(mail, "date"),
                "smtp_starttls_seen": seen("STARTTLS"),
            }
        )

    def split(after):
        blank = F.array_position(after, "")
        mail = F.when(blank > 0, F.slice(after, F.lit(1), (blank - 1).cast("int"))).otherwise(after)
        return bind(F.struct(commands.alias("commands"), mail.alias("mail"), (blank > 0).alias("body")), lambda s: named(s["commands"], s["mail"], s["body"]))

    return bind(after, split)


@dissector("FTP", "ftp", 27, "TCP", (21,))
class Ftp:
    def detect(p, port, l4):
        line = first_line(text(p))
        ok = (length(p) >= 3) & printable(line)
        return F.when(ok & line.rlike("^[0-9]{3}"), F.when(port == 21, 0.85).otherwise(0.6)).when(ok & line.rlike("^[A-Z]{3,4}(?: |$)"), F.when(port == 21, 0.75).otherwise(0.5)).otherwise(0.0)

    def fields(p, port, l4):
        ask = port == 21
        lines = F.filter(F.split(text(p), "\r\n|\n", -1), lambda x: x != "")
        bad = F.array_position(F.transform(lines, printable), False)
        lines = F.slice(F.when(bad > 0, F.slice(lines, F.lit(1), (bad - 1).cast("int"))).otherwise(lines), 1, 8)
        verb = lambda x: F.upper(F.substring_index(x, " ", 1))
        rest = lambda x: F.when(F.instr(x, " ") > 0, F.substring(x, F.instr(x, " ") + 1, F.length(x))).otherwise("")
        last = lambda own, read: F.element_at(F.when(F.size(own) > 0, F.transform(own, read)), -1)
        has = lambda v, test=None: F.filter(lines, lambda x: (verb(x) == v) & (test(rest(x)) if test else F.lit(True)))
        out = {
            "parse_warning": when(bad == 1, F.lit("ftp_line_not_printable_ascii")),
            "ftp_response_code": when(~ask, last(F.filter(lines, lambda x: x.rlike("^[0-9]{3}")), lambda x: F.substring(x, 1, 3))),
            "ftp_command": when(ask, last(lines, verb)),
            "ftp_password_present": when(ask & (F.size(has("PASS")) > 0), F.lit("true")),
            "ftp_auth_tls_requested": when(ask & (F.size(has("AUTH", lambda r: r.rlike("^(?i:TLS)"))) > 0), F.lit("true")),
        }
        for v in ("USER", "CWD", "TYPE", "RETR", "STOR", "PWD"):
            out[f"ftp_{v.lower()}_arg"] = when(ask, last(has(v, lambda r: r != ""), rest))
        return out


@dissector("POP3", "pop3", 43, "TCP", (110,), (0.5, 0.8))
class Pop3:
    def detect(p, port, l4):
        line = first_line(text(p))
        return (length(p) >= 3) & printable(line) & line.rlike(r"^(?:\+OK|-ERR|[A-Z]{3,4}(?: |$))")

    def fields(p, port, l4):
        line = first_line(text(p))
        ok, ask = printable(line), port == 110
        verb = F.upper(F.substring_index(line, " ", 1))
        rest = F.when(F.instr(line, " ") > 0, F.substring(line, F.instr(line, " ") + 1, F.length(line))).otherwise("")
        error = ok & ~ask & line.startswith("-ERR")
        out = {
            "pop3_status": when(ok & ~ask, F.when(line.startswith("+OK"), "+OK").when(error, "-ERR")),
            "pop3_error_reason": when(error & (F.length(line) > 5), F.substring(line, 6, 1 << 20)),
            "pop3_command": when(ok & ask, verb),
            "pop3_password_present": when(ok & ask & (verb == "PASS"), F.lit("true")),
        }
        for v in ("USER", "LIST", "RETR", "DELE", "TOP", "UIDL", "APOP"):
            out[f"pop3_{v.lower()}_arg"] = when(ok & ask & (verb == v) & (rest != ""), rest)
        return out


@dissector("MSNP", "msnp", 44, "TCP", (1863,), (0.5, 0.8))
class Msnp:
    def detect(p, port, l4):
        line = first_line(text(p))
        return (length(p) >= 3) & printable(line) & line.rlike("^[A-Z]{3}(?: |$)")

    def fields(p, port, l4):
        t = text(p)
        line = first_line(t)
        verb = F.substring_index(line, " ", 1)
        args = F.slice(F.filter(F.split(F.substring(line, F.length(verb) + 2, F.length(line)), " ", -1), lambda x: x != ""), 1, 4)
        n = F.size(args)
        arg = lambda i: F.get(args, F.lit(i))
        ok = printable(line)
        usr, cal, joi, msg = (ok & (verb == v) & (n >= k) for v, k in (("USR", 2), ("CAL", 2), ("JOI", 1), ("MSG", 3)))
        return {
            "msnp_command": when(ok, verb),
            "msnp_usr_email": when(usr, arg(1)),
            "msnp_usr_ticket_present": when(usr & (n >= 3), F.lit("true")),
            "msnp_cal_email": when(cal, arg(1)),
            "msnp_joi_email": when(joi, arg(0)),
            "msnp_msg_sender_email": when(msg & arg(0).contains("@"), arg(0)),
            "msnp_msg_transaction_id": when(msg & ~arg(0).contains("@"), arg(0)),
            "msnp_msg_length": when(msg, arg(2)),
            "msnp_msg_content_type": when(msg, header(header_lines(F.concat(t, F.lit("\r\n")), 64), "content-type")),
        }


@dissector("SSDP", "ssdp", 30, "UDP", (1900,), (0.6, 0.9))
class Ssdp:
    def detect(p, port, l4):
        line = first_line(text(p), True)
        return (length(p) >= 14) & F.length(line).between(14, 32) & line.rlike(r"^(?:M-SEARCH \* HTTP/1\.1|NOTIFY \* HTTP/1\.1|HTTP/1\.1)")

    def fields(p, port, l4):
        t = text(p)
        line = first_line(t, True)
        # a last line without an end counts too
        lines = header_lines(F.concat(t, F.lit("\r\n\r\n")), 12)
        method = F.when(line.startswith("M-SEARCH * HTTP/1.1"), "M-SEARCH").when(line.startswith("NOTIFY * HTTP/1.1"), "NOTIFY").when(line.startswith("HTTP/1.1"), "RESPONSE")
        return {"ssdp_method": method, **{f"ssdp_{k}": when(method.isNotNull(), header(lines, k)) for k in ("st", "nt", "nts", "location", "server", "usn")}}


@dissector("Syslog", "syslog", 31, "UDP TCP", (514, 601), (0.6, 0.85))
class Syslog:
    PRI = r"^<(?:[0-9]{1,2}|1[0-8][0-9]|19[01]|0[0-9]{2})>"

    def detect(p, port, l4):
        return (length(p) >= 4) & text(p).rlike(Syslog.PRI)

    def fields(p, port, l4):
        t = text(p)
        ok = t.rlike(Syslog.PRI)
        pri = F.regexp_extract(t, "^<([0-9]{1,3})>", 1).cast("int")
        body = F.substring(t, F.instr(t, ">") + 1, F.length(t))
        lines = F.split(F.regexp_replace(t, "\n$", ""), "\n", -1)
        # messages are counted up to a line without a priority
        end = F.array_position(F.transform(lines, lambda x: x.rlike(Syslog.PRI)), False)
        n = F.least(F.when(end > 0, end - 1).otherwise(F.size(lines)), F.lit(8))
        names = lambda of, i: F.get(F.array(*(F.lit(x) for x in of)), i)
        return {
            "parse_warning": F.when(~ok, "syslog_pri_not_found"),
            "syslog_pri": when(ok, pri.cast("string")),
            "syslog_facility": when(ok, names(FACILITIES, F.floor(pri / 8).cast("int"))),
            "syslog_severity": when(ok, names(SEVERITIES, (pri % 8).cast("int"))),
            "syslog_rfc5424": when(ok, F.when(body.startswith("1 "), "true").otherwise("false")),
            "syslog_message_preview": when(ok, F.substring(F.substring_index(body, "\n", 1), 1, 200)),
            "syslog_message_count": n.cast("string"),
        }


@dissector("WHOIS", "whois", 49, "TCP", (43,))
class Whois:
    def detect(p, port, l4):
        t = text(p)
        line = first_line(t)
        newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
        return F.when((port == 43) & (line != "") & printable(line), 0.75).when((port != 43) & (line != "") & printable(F.substring(line, 1, 64)) & (length(p) >= 50) & (newlines >= 2), 0.4).otherwise(0.0)

    def fields(p, port, l4):
        t = text(p)
        line = first_line(t)
        shown = F.regexp_replace(F.substring(t, 1, 128), r"[^\x20-\x7e\r\n\t]", ".")
        return {"whois_query": when((port == 43) & (line != "") & printable(line), F.substring(line, 1, 128)), "whois_response_preview": when((port != 43) & (t != ""), shown)}


@dissector("XMPP", "xmpp", 65, "TCP", (5222,), (0.6, 0.9))
class Xmpp:
    def detect(p, port, l4):
        return (length(p) >= 10) & text(p).rlike("^(?:<[?]xml|<stream:stream)")

    def fields(p, port, l4):
        t = text(p, 0, 512)
        attribute = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, k + "='([^']*)'", 1), F.lit("")), F.nullif(F.regexp_extract(t, k + '="([^"]*)"', 1), F.lit("")))
        to, sender = attribute("to"), attribute("from")
        return {"xmpp_stream_to": to, "xmpp_stream_from": sender, "xmpp_is_response": F.when(sender.isNotNull(), "true").otherwise("false")}


@dissector("SSH", "ssh", 8, "TCP", (22,), (0.6, 0.9))
class Ssh:
    def detect(p, port, l4):
        return (length(p) >= 4) & (text(p, 0, 4) == "SSH-")

    def fields(p, port, l4):
        t = text(p)
        banner = first_line(t)
        versions = F.regexp_extract(banner, "^SSH-([^-]*)-", 1)
        named = banner.rlike("^SSH-[^-]*-")
        pkt = cut(p, F.length(banner) + 2, length(p))
        n, size = length(pkt), be(pkt, 0, 4)
        short = (F.length(banner) + 2 >= length(p)) | (n < 6)
        bad = ~short & ((size < be(pkt, 4, 1) + 1) | (size + 4 > n))
        kex = ~short & ~bad & (be(pkt, 5, 1) == 20)
        # eight lists, each behind its length
        none = F.array().cast("array<string>")

        def step(s, _):
            at = s["at"]
            k = be(pkt, at, 4)
            fits = (at + 4 <= n) & (at + 4 + k <= n)
            return F.when(fits, F.struct((at + 4 + k).cast("int").alias("at"), F.concat(s["out"], F.array(text(pkt, at + 4, k))).alias("out"))).otherwise(s)

        lists = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(F.lit(22).alias("at"), none.alias("out")), step, lambda s: s["out"])
        named_lists = lambda x: field_map({k: F.get(x, F.lit(i)) for i, k in enumerate(KEX_LISTS)} | {"parse_warning": when(F.size(x) < 8, F.lit("truncated_kexinit_namelist"))})
        return {
            "ssh_identification_string": F.substring(banner, 1, 255),
            "ssh_protocol_version": when(named, versions),
            "ssh_software_version": when(named, F.regexp_extract(banner, "^SSH-[^-]*-([^ ]*)", 1)),
            "ssh_kexinit_present": when(~bad, F.when(kex, "true").otherwise("false")),
            "parse_warning": F.when(bad, "invalid_kexinit_packet_length"),
            "*": when(kex, bind(lists, named_lists)),
        }
