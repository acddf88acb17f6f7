"""Word lists, templates and weights that results depend on, as they must be."""

INSTRUCTION = "请根据商品属性生成一段中文电商广告文案，要求突出核心卖点，表达自然，有购买吸引力，不得编造未提供的信息。"
PREFIX = "商品属性："
FORBIDDEN = ["全球第一", "全网第一", "100%", "永久", "永不", "必买", "最强", "神级", "治疗", "治愈", "减肥", "guaranteed"]
AGENT_FORBIDDEN = ["全网第一", "100%", "百分百", "必买", "神级", "永久", "绝对", "最强", "第一"]
TYPES = {
    "上衣": ["上衣", "衬衫", "T恤", "卫衣", "外套"],
    "裙": ["裙", "半身裙", "连衣裙", "长裙", "短裙"],
    "裤": ["裤", "裤子", "长裤", "短裤", "阔腿裤", "牛仔裤"],
    "鞋": ["鞋", "鞋子", "运动鞋", "皮鞋", "高跟鞋", "凉鞋"],
    "包": ["包", "包包", "手提包", "斜挎包", "双肩包"],
}
COLOURS = ["白色", "黑色", "红色", "粉色", "蓝色", "绿色", "黄色", "卡其色", "深色", "浅色"]
MATERIALS = ["牛仔布", "蕾丝", "针织", "棉", "雪纺", "真丝", "皮革"]
DIAGNOSE_ALIASES = {
    "上衣": ["衬衫", "外套", "卫衣", "T恤", "针织衫", "毛衣", "开衫", "吊带", "背心"],
    "裙": ["裙", "裙子", "连衣裙", "半身裙"],
    "裤": ["裤", "裤子", "短裤", "长裤", "阔腿裤", "牛仔裤"],
}
UNSUPPORTED_COLOURS = ["多种颜色", "多色", "色彩丰富", "色彩斑斓", "撞色", "拼色", "黑白", "白色", "彩色"]
WEAK_EMPTY = "这款商品整体风格简洁，穿着体验舒适，适合多种日常场景。"
WEAK_SHORT = "这款商品整体设计简洁，材质舒适，日常穿搭省心。"
EXAGGERATED_EMPTY = "这款商品设计出众，穿搭体验舒适。"
EXAGGERATED_TAIL = "全网第一，效果100%，必买神级单品，品质永久 guaranteed。"
GENERIC = ("这是一款适合日常使用的时尚单品，整体风格自然百搭，围绕", "等特点进行搭配更出彩，轻松满足多场景穿搭需求。")
GENERIC_EMPTY = "这是一款适合日常使用的时尚单品，设计简洁百搭，轻松满足多场景需求。"
BASE_SHORT = "这款商品整体风格简洁，适合日常穿搭，舒适且百搭。"
SFT_EMPTY = ("这款单品围绕", "进行设计，风格自然，日常搭配轻松省心。")
DPO_EMPTY = ("这款商品围绕", "打造，穿着体验舒适，风格自然耐看，适合多场景搭配。")
DPO_ADDON = (" 同时结合", "等设计特点，整体更具辨识度。")
REWRITE_PREFIXES = ["改写后的文案：", "改写文案：", "修改后的文案：", "优化后的文案：", "文案：", "输出："]
REASONS = ["empty_content_or_summary", "contains_UNK", "summary_len_out_of_range", "content_attr_too_few", "low_chinese_ratio", "too_many_repeated_words", "high_repetition_ratio"]
PAIR_REASONS = ["chosen_score<=rejected_score", "score_gap<0.5", "chosen_has_forbidden", "chosen_equals_rejected", "chosen_source_generic_or_weak"]
JUDGE_KEYS = ["attribute_coverage", "factual_consistency", "naturalness", "attractiveness", "compliance"]
#: Prompt templates: {input}, {text}, {issues} and {comment} are replaced.
PLAIN_PROMPT_END = "请输出广告文案："
JUDGE_SYSTEM = "你是一个严格的电商广告文案评审员。你需要根据商品属性评估候选广告文案。请只输出 JSON，不要输出解释。"
JUDGE_PROMPT = """请根据以下商品属性和候选广告文案进行评分。

商品属性：
{input}

候选广告文案：
{text}

请从 5 个维度评分，每项 1 到 5 分：
1. attribute_coverage：是否覆盖主要商品属性
2. factual_consistency：是否避免编造未提供的信息
3. naturalness：中文表达是否自然
4. attractiveness：是否有电商广告吸引力
5. compliance：是否避免夸大、绝对化、虚假承诺

请严格输出如下 JSON 格式：
{
  "attribute_coverage": 1-5,
  "factual_consistency": 1-5,
  "naturalness": 1-5,
  "attractiveness": 1-5,
  "compliance": 1-5,
  "total": 5-25
}"""
AGENT_JUDGE_SYSTEM = "You are a strict evaluator for Chinese e-commerce advertisement copy. You must judge whether the generated copy faithfully follows the given product attributes. Return JSON only."
AGENT_JUDGE_PROMPT = """Please evaluate the following Chinese e-commerce ad copy.

Product attributes:
{input}

Generated copy:
{text}

Important judging rule:
Only evaluate attributes explicitly provided in the product attributes. Do not penalize the copy for not mentioning attributes that are not provided, such as length, sleeve type, collar type, brand, price, season, or target user, unless they appear in the input attributes.

Scoring dimensions, each from 1 to 5:
1. attribute_coverage: whether the copy covers the provided product attributes.
2. factual_consistency: whether the copy avoids fabricating unsupported attributes.
3. naturalness: whether the expression is fluent and natural.
4. attractiveness: whether the copy is appealing for e-commerce.
5. compliance: whether the copy avoids exaggerated or forbidden claims.

Return JSON only in this format:
{
  "attribute_coverage": 1-5,
  "factual_consistency": 1-5,
  "naturalness": 1-5,
  "attractiveness": 1-5,
  "compliance": 1-5,
  "issues": ["short issue 1", "short issue 2"],
  "comment": "short explanation"
}
"""
REWRITE_SYSTEM = "You are a professional Chinese e-commerce copywriter and compliance editor. Your task is to revise an ad copy according to product attributes and detected issues. Return the revised Chinese ad copy only. Do not explain."
REWRITE_PROMPT = """Please revise the following Chinese e-commerce ad copy.

Product attributes:
{input}

Original copy:
{text}

Detected issues:
{issues}

Judge comment:
{comment}

Revision requirements:
1. Keep the copy faithful to the provided product attributes.
2. Do not add unsupported attributes such as unprovided color, length, brand, season, price, target user, or fabric.
3. Cover the important provided attributes as much as possible.
4. Remove exaggerated or forbidden claims.
5. Keep the style natural, attractive, and concise.
6. Output only the revised Chinese ad copy. Do not include explanations.
"""
