"""What a column is, judged by its name."""

from __future__ import annotations

import datetime
import re

#: The column that keeps the order of a file's rows.
ROW = "__rid"
# Words in column names.
TIME = re.compile(r"(时间|日期|date|time|datetime|timestamp|年份|月份|年度|季度)|(?:日|月|年)$", re.I)
ID = re.compile(
    r"(?:^|[^a-z0-9])id(?:[^a-z0-9]|$)|编号|单号|券码|核销码|手机|号码|账号|账户|"
    r"(?:门店|计划|素材|店铺|商品|订单|用户|达人|券|活动|任务|视频)号|码$|uuid|uid|openid",
    re.I,
)
MONEY = re.compile(r"金额|(?<!单)元|消耗|花费|实付|应收|退款|成交|收入|成本|预算|结算|佣金|price|amount|gmv|销售额", re.I)
NOT_MONEY = re.compile(
    r"状态|类型|是否|数量|个数|笔数|单数|次数|率|占比|比例|时间|日期|编号|单号|id|备注|说明", re.I
)
STATUS = re.compile(r"状态|是否|类型|结果|status|state|result", re.I)
QUANTITY = re.compile(r"数量|个数|笔数|单数|件数|次数|人数|券数|订单数|条数|数$", re.I)
ORDER = re.compile(r"订单(号|ID|id|编号|单据号)|^订单$", re.I)
COUPON = re.compile(r"券码|券ID|券id|券号|核销码|卡券码|码$")
AFTER_SALE = re.compile(r"(退款|售后|退货).*(单号|编号|ID|id|券码)|(退款|售后)单")
MATERIAL = re.compile(r"素材|视频ID|视频id|作品")
PLAN = re.compile(r"计划|广告|推广|投放|单元")
STORE = re.compile(r"门店|店铺|门店名称|门店ID|门店id|poi", re.I)
DIMENSION = re.compile(r"门店|店铺|商品|素材|计划|活动|达人|视频|渠道|账号|区域")
EXPORT_TIME = re.compile(r"导出|下载|生成|拉取|统计时间|快照|更新时间")
DATE_COLUMN = re.compile(r"日期|时间|月份|年月|期间|周期|date|time|month|week")
AUDIT_QUANTITY = re.compile(r"数量|件数|张数|份数|人数|个数|笔数|台数|次数|购买数|券数|单数|qty|quantity", re.I)
AUDIT_AMOUNT = re.compile(
    r"金额|额|价格|单价|价|费用|费|收入|营收|实收|应收|应付|退款|补贴|佣金|优惠|amount|price|fee|revenue|cost|gmv", re.I
)
ID_COLUMN = re.compile(
    r"(^|[^a-z])(id|ids)($|[^a-z])|编号|单号|订单号|券码|核销码|条码|编码|序号|账号|手机|电话"
    r"|门店号|计划号|素材号|商品号|用户号|号$",
    re.I,
)
FILE_DATE = re.compile(r"(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})")


def kind(name: str, looks_like_time: bool = False) -> str:
    """时间 · ID · 金额 · 状态 by name in this order, then by value 时间, then 数量 or 文本."""
    if TIME.search(name):
        return "时间"
    if ID.search(name):
        return "ID"
    if is_money(name):
        return "金额"
    if STATUS.search(name):
        return "状态"
    return "时间" if looks_like_time else "数量" if QUANTITY.search(name) else "文本"


def is_money(name: str) -> bool:
    return not NOT_MONEY.search(name) and bool(MONEY.search(name))


def agg_method(name: str) -> str:
    """How a column of many rows becomes one value: quantities max, amounts sum, anything else first."""
    if AUDIT_QUANTITY.search(name) and not AUDIT_AMOUNT.search(name):
        return "max"
    return "sum" if AUDIT_AMOUNT.search(name) else "first"


def file_date(name: str) -> datetime.date | None:
    """The first valid date of 2000 to 2099 in a file name."""
    for y, m, d in FILE_DATE.findall(name):
        try:
            found = datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        if 2000 <= found.year <= 2099:
            return found
    return None


def column(headers: list[str], name: str) -> str:
    """The header that ``name`` means: exact, then without white space, then whatever its case; several are an error."""
    squeeze = lambda s: re.sub(r"[\s　 ]+", "", s)
    for same in (lambda h: h == name, lambda h: squeeze(h) == squeeze(name), lambda h: squeeze(h).lower() == squeeze(name).lower()):
        hits = [h for h in headers if same(h)]
        if len(hits) == 1:
            return hits[0]
        if len(hits) > 1:
            raise KeyError(f"column {name!r} is ambiguous: {hits}")
    raise KeyError(f"no column {name!r} among {headers}")
