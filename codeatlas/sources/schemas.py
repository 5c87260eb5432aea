"""Column types of extracted records."""

#: A literal of source text. kind: str, bool, int, float, list, dict, none, or other; text: as JSON for collections, as Python's str() for the rest.
ITEM = "struct<kind:string,text:string>"
VALUE = f"struct<kind:string,text:string,items:array<{ITEM}>>"
VALUES = f"map<string,{VALUE}>"

MANIFEST = f"path string, loose {VALUES}, strict {VALUES}, loose_error string, strict_error string"
FIELD = f"struct<name:string,owner:string,type:string,first:{VALUE},keywords:{VALUES}>"
CLASS = f"path string, class_name string, line_number int, bases array<string>, attributes {VALUES}, fields array<{FIELD}>, error string"
RECORD = "path string, id string, position int, fields map<string,struct<ref:string,text:string,eval:string,child:string>>, error string"
