"""Fixed output labels.

These strings are fixed values that must equal the original analysis so its
users get identical results.  They are kept together here, in the order the
analysis defines them, with an English gloss; swap a dictionary to relabel.
"""

# Category fallbacks.
UNCATEGORIZED = "未分类"          # "uncategorised" (foundational and phase-3 queries)
UNKNOWN = "unknown"               # phase-5 views

# Delay flags of the review-by-delay comparison.
DELAYED = "延迟送达"              # delivered late
NOT_DELAYED = "未延迟"            # not late

# Table names as reported by the row-count profiles.
TABLE_LABELS = {
    "customers": "customers",
    "orders": "orders",
    "order_items": "order_items",
    "order_payments": "order_payments",
    "order_reviews": "order_reviews",
    "products": "products",
    "sellers": "sellers",
    "category_translation": "product_category_name_translation",
    "geolocation": "geolocation",
}

# Repeat-purchase segments by delivered order count (1 / 2-3 / 4-6 / more).
REPEAT_ONCE = "一次购买客户"          # one-time buyer
REPEAT_LIGHT = "轻度复购客户"         # light repeat
REPEAT_MEDIUM = "中度复购客户"        # medium repeat
REPEAT_HEAVY = "高复购客户"           # heavy repeat

# Seller segments, in precedence order.
SELLER_SMALL_SAMPLE = "样本不足卖家"      # fewer than 5 delivered orders
SELLER_CORE = "核心优质卖家"              # core high quality
SELLER_HIGH_RISK = "高收入高风险卖家"      # high revenue, high risk
SELLER_REPUTATION = "口碑潜力卖家"         # reputation potential
SELLER_LOGISTICS = "物流重点优化卖家"      # logistics focus
SELLER_STABLE = "稳定普通卖家"             # stable regular

# Great-circle distance bands (upper bounds in km) and the earth radius.
DISTANCE_BANDS = [(100, "0-99 km"), (500, "100-499 km"), (1000, "500-999 km"), (2000, "1000-1999 km")]
DISTANCE_BAND_LAST = "2000 km 及以上"      # 2000 km and more
EARTH_RADIUS_KM = 6371.0

# Weekday names (0 = Monday) and day types.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKEND = "Weekend"
WEEKDAY = "Weekday"

# Customer value tiers, in precedence order.
TIER_HIGH_VALUE_REPEAT = "高价值复购客户"   # top payment quartile and frequency quartile >= 3
TIER_HIGH_TICKET = "高客单价值客户"         # top payment quartile
TIER_FREQUENT = "高频客户"                  # top frequency quartile
TIER_LOW_ACTIVITY = "低活跃低消费客户"       # bottom payment and frequency quartiles
TIER_REGULAR = "普通客户"                   # everyone else

# RFM segments, in precedence order.
RFM_BEST = "最佳客户"                # best
RFM_LOYAL = "忠诚客户"               # loyal
RFM_RECENT_BIG = "近期高消费客户"     # recent big spender
RFM_WIN_BACK = "需要唤醒的老客户"     # needs win-back
RFM_AT_RISK = "可能流失客户"          # probably lost
RFM_REGULAR = "普通客户"             # regular

# CLV segments by quartile 4, 3, 2, 1.
CLV_SEGMENTS = {4: "高 CLV 客户", 3: "中高 CLV 客户", 2: "中低 CLV 客户", 1: "低 CLV 客户"}

# Churn status by days since the last order (> 180, 90..180, else).
CHURN_LOST = "可能流失"      # probably churned
CHURN_RISK = "流失风险"      # churn risk
CHURN_ACTIVE = "活跃"        # active

# The 14 data-quality checks as (check_name, severity, explanation), in report order.
DQ_CHECKS = [
    ("已送达订单没有客户收货日期", "high",
     "order_status = delivered，但 order_delivered_customer_date 为空，物流时效无法计算。"),
    ("已送达订单没有承运商日期", "medium",
     "order_status = delivered，但 order_delivered_carrier_date 为空，部分物流拆解指标无法计算。"),
    ("订单没有支付记录", "high",
     "orders 中存在订单，但 order_payments 中没有对应 order_id，订单实付金额会缺失。"),
    ("订单没有商品明细", "high",
     "orders 中存在订单，但 order_items 中没有对应 order_id，商品金额和卖家归属会缺失。"),
    ("评分不在 1 到 5", "high", "review_score 应在 1 到 5 之间；超出范围会影响平均评分。"),
    ("商品价格缺失", "medium", "price 为空表示价格未知，不应默认改成 0。"),
    ("商品价格为负数", "high", "price 小于 0，商品交易额会被错误拉低。"),
    ("运费为负数", "high", "freight_value 小于 0，物流成本和订单总额会被错误计算。"),
    ("支付金额为负数", "high", "payment_value 小于 0，订单实付金额会被错误计算。"),
    ("支付金额缺失", "medium", "payment_value 为空表示支付金额未知，不应默认改成 0。"),
    ("纬度超出 -90 到 90", "high", "geolocation_lat 超出地球纬度范围，距离计算会失真。"),
    ("经度超出 -180 到 180", "high", "geolocation_lng 超出地球经度范围，距离计算会失真。"),
    ("审批时间早于下单时间", "medium", "order_approved_at 早于 order_purchase_timestamp，订单时间顺序异常。"),
    ("客户收货时间早于下单时间", "high",
     "order_delivered_customer_date 早于 order_purchase_timestamp，物流周期会出现负数。"),
]

# Check-constraint names, in the order they are added.
CONSTRAINT_NAMES = [
    "CK_phase4_order_items_item_sequence_positive",
    "CK_phase4_order_items_price_range",
    "CK_phase4_order_items_freight_range",
    "CK_phase4_order_payments_value_range",
    "CK_phase4_order_payments_installments_range",
    "CK_phase4_order_reviews_score_range",
    "CK_phase4_geolocation_lat_range",
    "CK_phase4_geolocation_lng_range",
    "CK_phase4_orders_delivery_after_purchase",
]

# Expected row counts of the full public dataset (load check).
EXPECTED_ROWS = {
    "customers": 99441, "orders": 99441, "products": 32951, "sellers": 3095,
    "category_translation": 71, "order_items": 112650, "order_payments": 103886,
    "order_reviews": 99224, "geolocation": 1000163,
}

# Names of the referential (orphan) checks, in order.
ORPHAN_CHECKS = [
    "orders_without_customer", "order_items_without_order", "order_items_without_product",
    "order_items_without_seller", "payments_without_order", "reviews_without_order",
    "products_without_category_translation",
]
