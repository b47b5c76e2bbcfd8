"""Row types of the tables this package writes, as DDL strings."""

STYLE = "map<string,string>"
ANNOTATION = (
    "struct<start:int,end:int,bold:boolean,href:string,target:string,emoji:string,style:map<string,string>>"
)
ANNOTATIONS = f"array<{ANNOTATION}>"
IMAGE = (
    "struct<src:string,srcset:string,sizes:string,display_src:string,alt:string,href:string,aspect_ratio:double,"
    "background_color:string,object_fit:string,object_position:string,visual_bleed_scale:double,visual_bleed_mode:string>"
)
GALLERY = f"struct<items:array<{IMAGE}>,aspect_ratio:double>"
CELL = "struct<text:string,header:boolean,col_span:int,row_span:int,style:map<string,string>>"
TABLE = f"struct<rows:array<array<{CELL}>>,column_count:int>"
CODE = "struct<language:string,tokens:array<string>>"
METRICS = "struct<replies:string,reposts:string,likes:string,views:string,bookmarks:string>"
MEDIA = (
    "struct<src:string,href:string,alt:string,aspect_ratio:double,object_fit:string,object_position:string>"
)
EMBED = (
    "struct<label:string,provider:string,presentation:string,href:string,title:string,text:string,"
    f"text_annotations:{ANNOTATIONS},text_style:{STYLE},author_name:string,author_handle:string,"
    f"author_avatar_url:string,published_at:string,published_at_text:string,metrics:{METRICS},media:array<{MEDIA}>>"
)
PLAYLIST = "struct<resolution:string,width:int,height:int,url:string>"
HLS = f"struct<master:string,audio:string,video_playlists:array<{PLAYLIST}>>"
VIDEO = (
    "struct<video_id:string,src:string,source_type:string,transport:string,"
    f"hls:{HLS},poster:string,aspect_ratio:double,preload:string,aria_label:string>"
)
PHOTO = "struct<src:string,display_src:string,alt:string,href:string>"
_CARD_FIELDS = (
    "title:string,excerpt:string,href:string,author_name:string,author_handle:string,author_avatar_url:string,"
    "author_verified:boolean,published_at:string,published_at_text:string,author_badge_avatar_url:string,"
    "reply_context_text:string,reply_to_handle:string,translation_source_text:string,"
    "translation_action_text:string,ai_generated_text:string"
)
COVER = (
    "struct<cover_url:string,cover_alt:string,aspect_ratio:double,source_label:string,title:string,excerpt:string,"
    "href:string,author_name:string,author_handle:string,author_verified:boolean,published_at_text:string>"
)
PREVIEW = "struct<src:string,alt:string,href:string,duration_text:string,aspect_ratio:double,layout:string>"
_ITEM_FIELDS = (
    f"node_id:int,type:string,text:string,annotations:{ANNOTATIONS},photos:array<{PHOTO}>,"
    f"preview:{PREVIEW},cover:{COVER},video:{VIDEO}"
)
QUOTED_ITEM = f"struct<{_ITEM_FIELDS}>"
QUOTED = f"struct<{_CARD_FIELDS},items:array<{QUOTED_ITEM}>>"
ITEM = f"struct<{_ITEM_FIELDS},quoted:{QUOTED}>"
TWEET = f"struct<{_CARD_FIELDS},items:array<{ITEM}>,metrics:{METRICS}>"
LIST_ITEM = f"struct<text:string,annotations:{ANNOTATIONS},style:{STYLE}>"

# One row of `blocks`: shared scalars plus one nullable struct per family.
BLOCK_FIELDS = {
    "type": "string", "role": "string", "level": "int", "kind": "string", "text": "string",
    "annotations": ANNOTATIONS, "text_style": STYLE, "href": "string", "target": "string",
    "items": f"array<{LIST_ITEM}>", "code": CODE, "table": TABLE, "image": IMAGE, "gallery": GALLERY,
    "video": VIDEO, "tweet": TWEET, "embed": EMBED,
}
BLOCK = "struct<" + ",".join(f"{k}:{v}" for k, v in BLOCK_FIELDS.items()) + ">"

# Stored articles (S2): one JSON object per line.
ARTICLE_JSON = (
    "id string, source string, sourceKind string, sourceProvider string, adapterId string, platform string, "
    "contentType string, sourceUrl string, canonicalUrl string, title string, extractedAt bigint, "
    "blocks array<struct<id:string,type:string,text:string,level:int,kind:string,items:array<string>,"
    "src:string,alt:string,href:string,aspectRatio:double,language:string,"
    "annotations:array<struct<startOffset:int,endOffset:int,bold:boolean,href:string>>,"
    "rows:array<struct<cells:array<struct<text:string,header:boolean>>>>,columnCount:int>>"
)
