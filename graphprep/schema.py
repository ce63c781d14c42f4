"""Schemas of the example model."""

from __future__ import annotations

NODE = "struct<id:int,type:string,label:string,is_repair_candidate:boolean>"
EDGE = "struct<src:int,dst:int,type:string>"
OUTPUT = "struct<kind:string,token:string,pointer:int,class:string>"

EXAMPLES = f"example_id string, split string, source string, task string, provenance string, nodes array<{NODE}>, edges array<{EDGE}>, output array<{OUTPUT}>, extras map<string,string>"

# Special tokens and reserved ids.
POINTER, CLASS_PREFIX, DONE, OOV, PAD = "POINTER", "CLASS_", "DONE", "<OOV>", "<pad>"
RESERVED = (OOV, PAD)
OOV_ID, PAD_ID = 0, 1
REVERSED = "REVERSED_"
SPLITS = ("train", "valid", "test")
SIZE_BUCKETS = (128, 256, 512, 1024, 2048, 4096, 8192)
EDIT_SEPARATOR = "!#@$"
EDIT_OPS = ("add_node", "del_node", "replace_val", "replace_type", "NoOp")
#: Train set sizes of the six tasks, from which oversampling weights follow.
TASK_SIZES = {"EC": 18480, "FD": 340846, "SO": 236246, "VM": 700708, "VMR": 700708, "WB": 459400}
